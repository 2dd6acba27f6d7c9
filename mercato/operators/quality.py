"""Type casts, key checks and column profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.quantiles import exact_quantiles

# Rows of the keys that one task counts, and parts of a frequent key.
KEYED_ROWS, SALTS = 1 << 18, 64


def cast_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows with every value cast to ``schema``, and the rows where a cast fails."""
    fields = [f for f in schema.fields if f.name in df.columns]
    failed = F.lit(False)
    for f in fields:
        failed = failed | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    return df.where(~failed).withColumns(cast), df.where(failed)


def check_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once or contain a NULL, with their row count.

    Nearly all key values differ, so sums on the map side would hold all of a
    task's rows: keys are dealt to more tasks where there are more rows. They
    are dealt with a salt first, so a frequent value is no task of its own.
    """
    null_part = F.lit(False)
    for key in keys:
        null_part = null_part | F.col(key).isNull()
    asked = df.select(*keys)
    tasks = max(1, math.ceil(asked.count() / KEYED_ROWS))
    salted = asked.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(tasks, *keys, "_salt")
    parts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    counted = parts.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("_rows").alias("n_rows"))
    return counted.where((F.col("n_rows") > 1) | null_part)


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child key values without a parent, with their row count; NULL is allowed."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(parent_column).alias(column))
    return used.join(known, column, "left_anti")


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: type, rows, NULLs and, for numbers, mean, deviation and quartiles.

    All but the quartiles comes from one pass; no column leaves the executors.
    """
    spark = df.sparkSession
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    totals = []
    for f in df.schema.fields:
        c = F.col(f.name)
        value = c.cast("double") if f.name in numeric else F.lit(None).cast("double")
        totals.append(F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(c.isNull()).alias("n_null"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("stddev"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        ))
    summary = df.agg(F.array(*totals).alias("s")).select(F.inline("s"))
    if not numeric:
        quartiles = spark.createDataFrame([], "column string, q25 double, median double, q75 double")
    else:
        def at(prob: float) -> Column:
            return F.max(F.when(F.col("prob") == prob, F.col("value")))

        quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]).groupBy("column").agg(
            at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75")
        )
    return summary.join(quartiles, "column", "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first; NULLs left out."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), column)
