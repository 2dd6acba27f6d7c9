"""Counts against plain Python, cutoffs against exact binomial tails."""

import math
import random
import re

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mercato.llm import quality as op

SCHEMA = "doc_id long, text string, lang string, n_words string, Kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bc", "Ünï", "😀x", "#tag", "a|b", "ok!"])
    made = [rng.choice([" ", "\n", "\t", "  ", "\x0b", " "]).join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    once = " ".join(f"w{i}" for i in range(30))
    return made + [None, "", " \n\n ", "x", once, once + "\n" + once, once + " " + " ".join(once.split()[:9]), "one " * 3000,
                   "a b c d e f g h", "a b c d e f g h a b c d e f g h", "line one\nline one\n\nline one \n", "same\n" * 50]


def test_counts(spark):
    rows = [(i, t, "en", "x", 3) for i, t in enumerate(texts())] + [(0, texts()[0], None, None, None), (None, "y", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    found = op.quality_verdicts(docs, labels).collect()
    expected = sorted(((r[0],) + brute(r[1]) for r in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in found), key=repr) == expected
    for r in found:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


@pytest.mark.parametrize("n, k, share", [(10, 0, 0.1), (500, 3, 0.0125), (500, 6, 0.0125), (2000, 10, 0.0125), (20000, 200, 0.0125), (0, 0, 0.1)])
def test_tail_is_the_exact_sum(spark, n, k, share):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                         + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(k + 1))
    found = spark.range(1).select(op.tail(F.lit(n), F.lit(k), share)).first()[0]
    assert math.isclose(found, 1.0 if k >= n * share else exact, rel_tol=1e-9)


def labelled(spark, n, share, seed):
    """Good documents of which ``share`` have many symbols, in two strata; the second has few labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        dirty = rng.random() < share
        rows.append((i, " ".join((f"w{j}#" if dirty else f"w{j}") for j in range(25)), "en" if i % 50 else None, "", 0))
        labels.append((i, 1))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_only_where_they_are_proven(spark):
    docs, labels = labelled(spark, 1500, 0.0, 1)
    tests = op.calibrate(op.measured(docs), labels)
    last = {(r["stratum"], r["rule"]): r["accepted"] for r in tests.where("step = 10").collect()}
    assert last["=en", "symbols"] and not last["-", "symbols"]
    docs, labels = labelled(spark, 1500, 0.03, 2)
    accepted = op.calibrate(op.measured(docs), labels).where("stratum = '=en' AND rule = 'symbols'").orderBy("step").collect()
    assert not any(r["accepted"] for r in accepted if r["cutoff"] <= 1.0)


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark, 1500, 0.0, 1)
    bad = docs.where("doc_id < 100 AND lang = 'en'").select(
        (F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", " ", "% ").alias("text"), "lang", "n_words", "Kept")
    left = op.keep_good(docs.union(bad), labels)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(1500))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op.quality_verdicts(docs, labels).count() == 0 and op.keep_good(docs, labels).count() == 0


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    entry.queries()["op1_quality_rules"](spark, sf_dir).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_same_as_sql(spark, sf_dir):
    name = "op1_quality_rules"
    _, problem = compare(spark, connect(sf_dir), entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert not problem
