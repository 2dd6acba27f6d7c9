"""Tail and random samples, first-seen rows and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_sample(df: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """The last ``n`` rows by ``order``."""
    return df.orderBy(F.desc(order)).limit(n)


def shuffle_key(key: Column, seed: int) -> Column:
    """A text that sorts rows in a random but repeatable order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


SALTS = 64


def random_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group without replacement, all of a smaller group.

    A group is ranked in salted parts first, so that a very large one is spread
    over many tasks; ``n`` rows of each part are left for the second ranking.
    """
    order = [shuffle_key(F.col(key), seed), F.col(key)]
    df = _first(df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS))), [group, "_salt"], order, n).drop("_salt")
    return _first(df, [group], order, n)


def _first(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def split_random(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key; the same rows on every run."""
    limit = f"{int(share * 2**32):08x}"
    low = F.substring(shuffle_key(F.col(key), seed), 1, 8) < limit
    return df.where(low), df.where(~low)


def row_ids(df: DataFrame, prefix: str, index: str, out: str = "id") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit(prefix), F.col(index).cast("string")))


def dedupe_first_seen(hits: DataFrame, group: str, item: str, order: list[str]) -> DataFrame:
    """The first row of each item in its group, by ``order``, and its place among them.

    ``seen`` counts from 0 in the order in which the items first appeared.
    """
    others = [c for c in hits.columns if c not in (group, item)]
    first = hits.groupBy(group, item).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    appeared = Window.partitionBy(group).orderBy(*order, item)
    return first.select(group, item, "_first.*").withColumn("seen", F.row_number().over(appeared) - 1)
