"""Exact quantiles of whole columns.

``percentile`` keeps every distinct value of a column in one task. Here an
approximate pass only brackets each wanted rank; the rows between the brackets
(a share of about 2e-4, or some rows of a short column) are then counted value
by value, and the exact value is the one at the wanted rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000
# Ranks that a bracket reaches to either side at least.
SPARE = 4


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Rows ``(column, prob, value)``, linearly interpolated, NULLs left out."""
    spark = df.sparkSession
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = values.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    margins = [max(2.0 / ACCURACY, SPARE / max(1, counts[f"n_{i}"])) for i in range(len(columns))]
    cuts = [sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-m, m)}) for m in margins]
    first = values.agg(
        *[F.percentile_approx(c, cuts[i], ACCURACY).alias(f"cut_{i}") for i, c in enumerate(columns)]).first()

    # Targets per bracket: a bracket is counted once, however many ranks it is wanted for.
    brackets: dict[tuple, list] = {}
    for i, column in enumerate(columns):
        count = counts[f"n_{i}"]
        if not count:
            continue
        cut = dict(zip(cuts[i], first[f"cut_{i}"]))
        for prob in probs:
            ends = cut[max(0.0, prob - margins[i])], cut[min(1.0, prob + margins[i])]
            brackets.setdefault((column, *ends), []).append((prob, (count - 1) * prob))
    if not brackets:
        return spark.createDataFrame([], "column string, prob double, value double")

    below = values.agg(*[
        F.count_if(F.col(column) < low).alias(f"below_{i}") for i, (column, low, _) in enumerate(brackets)
    ]).first()
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("bracket"),
            F.when(F.col(column).between(low, high), F.col(column)).alias("value"),
        )
        for i, (column, low, high) in enumerate(brackets)
    ])
    counted = (
        values.select(F.explode(wanted).alias("w"))
        .select("w.*")
        .where(F.col("value").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    targets = F.array(*[
        F.array(*[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(prob).alias("prob"),
                F.lit(math.floor(rank) - below[i]).cast("bigint").alias("rank"),
                F.lit(math.ceil(rank) - below[i]).cast("bigint").alias("next"),
                F.lit(rank - math.floor(rank)).alias("part"),
            )
            for prob, rank in ranks
        ])
        for i, ((column, _, _), ranks) in enumerate(brackets.items())
    ])
    running = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    from_rank, to_rank = F.col("upto") - F.col("n"), F.col("upto")
    touched = F.filter(targets[F.col("bracket")], lambda t: (t["next"] >= from_rank) & (t["rank"] < to_rank))
    lower, upper = F.col("lower"), F.col("upper")

    def value_at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= from_rank) & (F.col(rank) < to_rank), F.col("value")))

    return (
        counted.withColumn("upto", F.sum("n").over(running))
        .select("value", "n", "upto", F.inline(touched))
        .groupBy("column", "prob", "part")
        .agg(value_at("rank").alias("lower"), value_at("next").alias("upper"))
        .select("column", "prob", (lower + (upper - lower) * F.col("part")).alias("value"))
    )


def quantile_map(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Quantiles on the driver: one number per column and probability, None for columns without values."""
    found = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, columns, probs).collect()}
    out = {c: [found.get((c, p)) for p in probs] for c in columns}
    for column, values in out.items():
        if None in values and not df.where(F.col(column).isNotNull()).isEmpty():
            raise RuntimeError(f"a quantile of {column} lies outside its bracket")
    return out
