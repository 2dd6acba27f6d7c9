"""Running values along a position, without one task per group.

A plain window puts a whole group into one task. Here a group is cut into
blocks of consecutive positions: each block is scanned on its own, the short
block summaries are scanned (again in blocks), and what came before a block is
joined back to its rows. A group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.sources.files import materialize

# With two levels of blocks no window exceeds a block up to 4096 ** 2 positions
# in a group; beyond that the windows over block summaries grow slowly.
BLOCK_ROWS, LEVELS = 4096, 1


def running_total(
    df: DataFrame, keys: list[str], position: str, value: str, out: str,
    block_rows: int = BLOCK_ROWS, levels: int = LEVELS,
) -> DataFrame:
    """Sum of ``value`` up to and including the row, by integer ``position``.

    Positions are unique within ``keys``.
    """
    return _scan(
        df, keys, position, value, out,
        over=F.sum,
        summarize=lambda v, _: F.sum(v),
        merge=lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
        block_rows=block_rows, levels=levels, end=Window.currentRow,
    )


def carry_forward(
    df: DataFrame, keys: list[str], position: str, value: str, out: str,
    block_rows: int = BLOCK_ROWS, levels: int = LEVELS,
) -> DataFrame:
    """Latest non-null ``value`` up to and including the row."""
    return _scan(
        df, keys, position, value, out,
        over=lambda v: F.last(v, ignorenulls=True),
        summarize=lambda v, p: F.max_by(v, F.when(v.isNotNull(), p)),
        merge=lambda before, here: F.coalesce(here, before),
        block_rows=block_rows, levels=levels, end=Window.currentRow,
    )


def dense_index(
    df: DataFrame, keys: list[str], position: str, out: str,
    block_rows: int = BLOCK_ROWS, levels: int = LEVELS,
) -> DataFrame:
    """0, 1, 2, … in the order of a unique integer ``position``."""
    one = "_one"
    counted = running_total(df.withColumn(one, F.lit(1)), keys, position, one, out, block_rows, levels)
    return counted.withColumn(out, (F.col(out) - 1).cast("bigint")).drop(one)


def ordered_index(df: DataFrame, order: str, out: str) -> DataFrame:
    """0, 1, 2, … over the whole table in the order of a unique column of any type.

    Rows are dealt to ranges of ``order`` and numbered there; the sizes of the
    ranges, one number each, give the first number of a range.
    """
    part, first = "_part", "_first"
    ranged = materialize(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select(
        part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranged.withColumn(out, rank).join(firsts, part).withColumn(out, (F.col(out) + F.col(first)).cast("bigint")).drop(part, first)


def _scan(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, *,
    over: Callable[[Column], Column],
    summarize: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    block_rows: int, levels: int, end: int,
) -> DataFrame:
    def frame(*partition: str):
        return Window.partitionBy(*partition).orderBy(position).rowsBetween(Window.unboundedPreceding, end)

    if levels == 0:
        return df.withColumn(out, over(F.col(value)).over(frame(*keys)))

    block, here, before = f"_block{levels}", f"_here{levels}", f"_before{levels}"
    blocked = df.withColumn(block, F.floor(F.col(position) / block_rows))
    summary = blocked.groupBy(*keys, block).agg(summarize(F.col(value), F.col(position)).alias(value))
    carried = _scan(
        summary, keys, block, value, before,
        over=over, summarize=summarize, merge=merge,
        block_rows=block_rows, levels=levels - 1, end=-1,
    ).drop(value)
    return (
        blocked.withColumn(here, over(F.col(value)).over(frame(*keys, block)))
        .join(carried, [*keys, block])
        .withColumn(out, merge(F.col(before), F.col(here)))
        .drop(block, here, before)
    )
