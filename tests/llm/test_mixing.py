"""The mix against plain Python and the laws it keeps."""

import random
from collections import Counter, defaultdict

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from mercato.llm import mixing as op

SCHEMA = "doc_id long, text string, source string, size int, target string"


def shares(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        above = [s for s in free if level * w[s] > most * sizes[s]]
        if not above:
            return target | {s: level * w[s] for s in free}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1, None: 40}, {"a": 0, "b": 0}, {"a": 7}, {"é": 10, "z": 10, "Z": 1000, "": 3, "b": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in op.source_targets(rows).collect()}
    assert found == pytest.approx(shares(sizes))


def corpus(n=900):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None]), 1, "") for i in range(n)]
    return rows + [(n, None, "a", 0, None), (None, "x y", "b", 0, None), (5, rows[5][1], rows[5][2], 2, ""), (n + 1, "long " * 5000, "d", 0, ""), (n + 2, "", "empty", 0, "")]


def test_taken_words(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = op.words_taken(docs, block_words=300).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    taken, sizes, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    by_id = {r[0]: (len((r[1] or "").split()), r[2]) for r in rows}
    for r in found:
        size, source = by_id[r["doc_id"]]
        assert r["size"] == size and r["taken"] % max(size, 1) == 0 and r["taken"] <= 3 * size
        assert len(r["shards"]) * size == r["taken"]
        taken[source] += r["taken"]
        sizes[source] += size
        largest[source] = max(largest[source], size)
    for source, target in shares(sizes).items():
        assert abs(taken[source] - target) <= largest[source]
        assert all(r["target"] == pytest.approx(target) for r in found if by_id[r["doc_id"]][1] == source)


def test_shards_are_balanced_mixed_and_repeatable(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(4)
    _, mixed = op.mix(docs, shards=4, block_words=100)
    rows = mixed.collect()
    _, again = op.mix(docs.repartition(2), shards=4, block_words=100)
    assert sorted((r["id"], r["pass"], r["shard"]) for r in rows if r["id"] is not None) == sorted(
        (r["id"], r["pass"], r["shard"]) for r in again.collect() if r["id"] is not None)
    for shard in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 4) < 0.25 * len(rows) / 4
    assert len({(r["pos"], r["pass"]) for r in rows}) == len(rows)


def test_mixed_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    times = Counter()
    for r in op.words_taken(docs).collect():
        times[r["doc_id"]] += len(r["shards"])
    out = op.mixed_rows(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert Counter(r["doc_id"] for r in out.collect()) == +times


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.words_taken(empty).count() == 0 and op.mixed_rows(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 0, ""), (2, None, None, 0, "")], SCHEMA)
    assert [r["taken"] for r in op.words_taken(blank).collect()] == [0, 0]


def test_same_as_sql(spark, sf_dir):
    name = "op9_mix_sources"
    _, problem = compare(spark, connect(sf_dir), entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert not problem
