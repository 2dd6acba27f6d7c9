"""Line dedup against counting in plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from mercato.llm import lines as op

SCHEMA = "doc_id long, text string, n_lines string, `a.b` int, _mark string, _told_id string"


def key_of(line):
    stripped = line.strip(" \t\n\x0b\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute(rows, least_chars, least_docs):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(doc)
    shared = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        left = [x for x in parts if key_of(x) not in shared or shared[key_of(x)] == doc]
        out.append((doc, text if text is None else "\n".join(left), len(parts), len(parts) - len(left)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    pool = ["shared line %d with some more words in it to be long enough" % i for i in range(12)]
    pool += ["Größe und Länge der Zeile " + "ä" * 14, "Größe und Länge der Zeile " + "ä" * 13, "short", "", "  ", "x" * 40, "y" * 39]
    rows = []
    for doc in range(60):
        picked = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        picked = [rng.choice([x, x.upper(), f"\t{x} \r", x]) for x in picked]
        rows.append((doc, "\n".join(picked)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, pool[0]), (None, pool[1]), (7, rows[7][1]), (7, rows[7][1]), (7, pool[0])]
    rows.append((63, "\n".join(pool * 3000) + "\nthe end"))
    return rows


@pytest.mark.parametrize("least_chars, least_docs", [(40, 5), (1, 2), (40, 1), (40, 500)])
def test_lines_as_by_brute_force(spark, least_chars, least_docs):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "old", 1, None, "q") for r in rows], SCHEMA).repartition(5)
    found = op.drop_shared_lines(docs, least_chars=least_chars, least_docs=least_docs)
    assert found.columns == [*docs.columns, "n_lines_0", "n_dropped"]
    got = found.select("doc_id", "text", "n_lines_0", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, least_chars, least_docs)
    assert {tuple(r) for r in found.select("n_lines", "`a.b`", "_mark", "_told_id").collect()} == {("old", 1, None, "q")}


def test_lines_that_few_or_many_documents_hold_go_alike(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (0.0, 1e-2, 1.0):
        monkeypatch.setattr(op, "HOT_SHARE", share)
        assert sorted(map(tuple, op.drop_shared_lines(docs).collect()), key=repr) == brute(rows, 40, 5)


def test_an_empty_table_and_columns_of_any_type(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.drop_shared_lines(docs).collect() == []
    tagged = spark.createDataFrame([(i, "z" * 50) for i in range(6)], "doc_id long, text string").withColumn(
        "tags", F.create_map(F.lit("k"), F.col("doc_id")))
    found = {r["doc_id"]: (r["text"], r["tags"]) for r in op.drop_shared_lines(tagged).collect()}
    assert found == {i: ("z" * 50 if i == 5 else "", {"k": i}) for i in range(6)}
