"""Exact deduplication against plain grouping."""

import hashlib
import random

import pytest

from mercato.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, lang string, Mark string, kept int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(key)
    out = []
    for text, keys in groups.items():
        order = sorted(keys, key=lambda k: -1 if k is None else k)
        for i, key in enumerate(order):
            out.append((key, order[-1], len(keys), i == len(order) - 1, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(9000))
    texts = [long, long.upper(), long + ".", long[:-1], "", None, "Ä", "ä", "a" * 200_000, "A" * 200_000, "a" * 200_001, "x"]
    texts += [" ".join(word() for _ in range(rng.randint(0, 900))) for _ in range(20)]
    rows = [(i, t, "en", "m", 1) for i, t in enumerate(texts + texts[3:15])]
    return rows + [(7, "ä", "de", None, 2), (7, "ä", "de", None, 2), (None, "x", None, None, None), (None, None, "fr", "q", 0)]


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_as_by_brute_force(spark, bits):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = op.exact_groups(docs, bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_kept_rows_have_their_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    left = op.drop_copies(docs)
    assert left.schema == docs.schema
    texts = [lowered(r["text"]) for r in left.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in rows})


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.exact_groups(docs).count() == 0 and op.drop_copies(docs).count() == 0


def test_cuts_follow_the_content():
    data = random.Random(1).randbytes(3_000_000)
    parts = op.pieces(data)
    assert b"".join(parts) == data
    assert all(op.MIN_CHUNK <= len(p) <= op.MAX_CHUNK for p in parts[:-1])
    moved = op.pieces(b"something in front" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)


def test_cuts_are_the_same_in_blocks(monkeypatch):
    data = random.Random(2).randbytes(100_000)
    whole = op.cut_points(data)
    monkeypatch.setattr(op, "BLOCK", 1000)
    assert op.cut_points(data) == whole
