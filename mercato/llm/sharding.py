"""Uniform shuffle into shards by a hypergeometric communication matrix.

How many rows every partition sends to every shard is drawn first, from the
distribution that a uniform shuffle has. Partitions then permute their own
rows and deal them out by these counts, and shards permute what they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import free_name, stored, uniform
from mercato.llm.hypergeometric import splitting_tree

ROWS_PER_BUCKET = 4096


def communication_matrix(rows: DataFrame, part: str, shards: int, seed: int) -> DataFrame:
    """``(part, ends)``: the rows of a partition up to ``ends[s]`` of its order go to the shards up to ``s``.

    One number per partition is gathered, never rows.
    """
    counted = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.count()
    root = counted.agg(F.sort_array(F.collect_list(F.struct(part, "n"))).alias("all")).select(
        F.col("all")[part].alias("ids"), F.col("all")["n"].alias("sizes"),
        F.aggregate(F.col("all")["n"], F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    room = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    root = stored(root.withColumn("counts", room), "partitions")
    tree = splitting_tree(root.select("sizes", "counts"), parts, seed)
    names = root.select(F.posexplode("ids").alias("leaf", part))
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("counts", 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    return stored(tree.join(names, "leaf").select(part, ends.alias("ends")), "matrix")


def uniform_shards(rows: DataFrame, shards: int, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (from 0, without gaps in each shard).

    Shards differ by one row at most, and every arrangement is equally likely.
    Nothing but a row's place decides, so nulls, ties, repeated rows, texts of
    any length and hot keys make no difference; an empty table stays empty.
    Names that ``rows`` already uses are numbered (``shard_0``). Pass few
    columns to plan a shuffle, or all to carry it out: they are written once,
    with their places, so that a lost executor's rows come back the same.
    """
    shard, slot, part, place, ends, bucket, key, first = (
        free_name(rows, n) for n in ("shard", "slot", "_part", "_place", "_ends", "_bucket", "_key", "_first"))
    kept = stored(
        rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "rows")
    total = kept.count()
    if not total:
        return kept.select(*rows.columns, F.lit(0).alias(shard), F.lit(0).cast("long").alias(slot))
    matrix = communication_matrix(kept, part, shards, seed).withColumnRenamed("ends", ends)
    turn = F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(place, F.lit(seed)), place)) - 1
    dealt = kept.withColumn(key, turn).join(matrix, part).withColumn(
        shard, F.size(F.filter(ends, lambda e: e <= F.col(key))))
    # Permuted again: by a second random number, in buckets of limited size.
    buckets = -(-total // (shards * rows_per_bucket))
    dealt = dealt.withColumn(key, uniform(F.col(place), seed, 1))
    dealt = stored(dealt.withColumn(bucket, F.floor(F.col(key) * buckets).cast("int")).drop(part, ends), "dealt")
    sizes = dealt.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(sizes.select(
        shard, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)), "offsets")
    rank = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(key, place)) - 1
    return dealt.withColumn(slot, rank).join(firsts, [shard, bucket]).select(
        *rows.columns, shard, (F.col(slot) + F.col(first)).cast("long").alias(slot))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 0) -> str:
    """Carry out the shuffle: one folder per shard, its rows in the order of their slots."""
    placed = uniform_shards(rows, shards, seed)
    shard, slot = placed.columns[-2:]
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return path
