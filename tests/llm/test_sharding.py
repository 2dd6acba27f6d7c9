"""The shuffle against what a uniform shuffle must do."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mercato.llm import hypergeometric as hg
from mercato.llm import sharding


def pmf(g, b, t, x):
    return math.comb(g, x) * math.comb(b, t - x) / math.comb(g + b, t)


@pytest.mark.parametrize("g, b, t", [(5, 7, 4), (0, 9, 3), (9, 0, 3), (40, 3, 41), (1000, 3000, 500), (6, 6, 0), (6, 6, 12)])
def test_draw_inverts_the_distribution(spark, g, b, t):
    n = 2000
    us = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    found = Counter(r[0] for r in us.select(hg.draw(F.lit(g), F.lit(b), F.lit(t), F.col("u"))).collect())
    for x in range(max(0, t - b), min(g, t) + 1):
        # Equal steps of u meet each value in proportion, up to a step at either end of its intervals.
        assert abs(found.get(x, 0) - n * pmf(g, b, t, x)) <= 2
    assert sum(found.values()) == n


def test_draw_of_large_counts(spark):
    us = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
    found = [r[0] for r in us.select(hg.draw(F.lit(10**9), F.lit(3 * 10**9), F.lit(10**6), F.col("u"))).collect()]
    # Steps of u fall on either side of the mode as if by chance: the mean has an error of 433 / 20.
    assert abs(sum(found) / 400 - 250_000) < 65 and 400 < (sum((x - 250_000) ** 2 for x in found) / 400) ** 0.5 < 440


def test_tree_keeps_the_sums(spark):
    sizes, counts = [5, 0, 7, 1, 12, 3, 9], [10, 0, 20, 7]
    root = spark.createDataFrame([(sizes, counts)], "sizes array<long>, counts array<long>")
    rows = sorted(hg.splitting_tree(root, len(sizes), 3).collect())
    assert [r["leaf"] for r in rows] == list(range(7)) and [r["size"] for r in rows] == sizes
    assert [sum(r["counts"]) for r in rows] == sizes
    assert [sum(c) for c in zip(*(r["counts"] for r in rows))] == counts


def test_tree_is_fair(spark):
    """The number of the first kind in the third of four leaves, over many seeds, against its distribution."""
    root = spark.createDataFrame([([2, 3, 4, 3], [5, 4, 3])], "sizes array<long>, counts array<long>")
    seeds = root.crossJoin(spark.range(3000)).select(
        hg.draw_vector(F.col("counts"), F.lit(4), F.col("id"), F.lit(0)).alias("v"))
    found = Counter(r["v"][1] for r in seeds.collect())
    for x in range(5):
        assert abs(found[x] / 3000 - pmf(4, 8, 4, x)) < 0.04


@pytest.mark.parametrize("n, shards, parts, bucket", [(1000, 8, 5, 50), (7, 8, 3, 50), (1, 3, 2, 1), (130, 1, 4, 16)])
def test_sizes_and_slots(spark, n, shards, parts, bucket):
    rows = spark.range(n).select((F.col("id") % 3).alias("Shard"), "id", F.lit(None).cast("string").alias("slot")).repartition(parts)
    out = sharding.uniform_shards(rows, shards, 1, bucket)
    assert out.columns == ["Shard", "id", "slot", "shard_0", "slot_0"]
    found = out.collect()
    assert sorted(r["id"] for r in found) == list(range(n))
    sizes = Counter(r["shard_0"] for r in found)
    assert all(n // shards <= sizes.get(s, 0) <= -(-n // shards) for s in range(shards))
    for s in sizes:
        assert sorted(r["slot_0"] for r in found if r["shard_0"] == s) == list(range(sizes[s]))


def test_places_are_uniform(spark):
    """Ids in 4 partitions: where an id goes does not follow where it came from."""
    n, cells = 4000, Counter()
    for seed in range(3):
        out = sharding.uniform_shards(spark.range(n, numPartitions=4), 4, seed, 300).collect()
        cells.update((r["id"] * 4 // n, r["shard"], r["slot"] * 4 // 1000) for r in out)
    expected = 3 * n / 64
    assert sum((cells[i, s, q] - expected) ** 2 / expected for i in range(4) for s in range(4) for q in range(4)) < 103


def test_repeatable_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 4, "id int, t string").coalesce(1)
    one, two = (sorted(map(repr, sharding.uniform_shards(rows, 2, 9).collect())) for _ in range(2))
    assert one == two and len(one) == 9
    assert sharding.uniform_shards(rows.limit(0), 4).count() == 0


def test_write_shards(spark, tmp_path):
    rows = spark.range(100).withColumn("text", F.lit("x"))
    back = spark.read.parquet(sharding.write_shards(rows, str(tmp_path / "out"), 3))
    assert back.count() == 100 and Counter(r["shard"] for r in back.collect()).most_common() == [(0, 34), (1, 33), (2, 33)]


def test_query(spark, sf_dir):
    found = entry.queries()["op3_hypergeometric_shards"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
