"""Passages against a count of all stretches."""

import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from mercato.llm import passages as op
from mercato.llm import shingles

SCHEMA = "doc_id long, text string, start string, Run int, lang string"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w]


def brute(rows, least=50):
    texts = [(r[0], words_of(r[1])) for r in rows]
    seen = Counter(tuple(w[i:i + least]) for _, w in texts for i in range(len(w) - least + 1))
    out = set()
    for key, w in texts:
        spans = []
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i:i + least])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out |= {(key, a, b - a, " ".join(w)) for a, b in spans}
    return sorted(((k, a, n) for k, a, n, _ in out), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (30, 49, 50, 51, 60, 75, 140)]
    common = fresh(55)
    texts = []
    for i in range(90):
        text = fresh(rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) - 45))
            text += p[a:] + fresh(rng.choice([0, 0, 1, 40]))
        if i % 3 == 0:
            text += common + fresh(rng.randint(0, 20))
        texts.append(text)
    texts += [texts[4] + [], texts[5][:-1], ["same"] * 49, ["alone"] * 50, ["once"] * 51, ["often"] * 400, ["often"] * 70, ["a", "b", "c"] * 30]
    long = fresh(5000)
    texts += [long, long[:2000] + ["edit"] + long[2001:]]
    made = [" ".join(t) if rng.random() < 0.8 else "\n".join(t).upper() for t in texts] + [None, "", " \n"]
    rows = [(i, t, "x", 1, "en") for i, t in enumerate(made)]
    rng.shuffle(rows)
    twin = next(r for r in rows if r[1] and len(words_of(r[1])) > 60)
    return rows + [twin, (None, " ".join(shared[5]), None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("seed, together, bundle", [(1, op.TOGETHER, op.BUNDLE), (2, 3, 40), (3, 10, 1)])
def test_all_repeated_stretches(spark, monkeypatch, seed, together, bundle):
    monkeypatch.setattr(op, "TOGETHER", together)
    monkeypatch.setattr(op, "BUNDLE", bundle)
    rows = corpus(seed)
    found = op.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_words"]) for r in found), key=repr) == brute(rows)


def test_empty_and_short(spark):
    assert op.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, " ".join(["x", "y"] * 20), "", 0, "") for i in range(3)]
    assert op.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_runs_and_minima():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 200).astype(np.uint64)
    for n in (1, 2, 3, 5, 10, 41, 50, 64):
        slow = []
        for i in range(len(words) - n + 1):
            h = 0
            for w in words[i:i + n].tolist():
                h = (h * int(shingles.ODD) + w) % 2**64
            slow.append(h)
        assert (shingles.run_hashes(words, n) == shingles.mixed(np.array(slow, np.uint64))).all()
        assert shingles.sliding_min(words, n).tolist() == [words[i:i + n].min() for i in range(len(words) - n + 1)]
    assert len(shingles.run_hashes(words[:4], 5)) == len(shingles.sliding_min(words[:4], 5)) == 0


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = entry.queries()["op5_repeated_passages"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_words"]) for r in found), key=repr) == brute(rows)
    assert len({r["doc_id"] for r in found}) < len(rows)
