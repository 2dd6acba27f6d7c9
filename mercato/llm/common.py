"""What several corpus operators share."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import scratch_path
from mercato.sources.files import write_table

# A word is a run of characters other than these six.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not use, not even in another case."""
    taken = {c.lower() for c in df.columns}
    names = itertools.chain([wish], (f"{wish}_{i}" for i in itertools.count()))
    return next(n for n in names if n.lower() not in taken)


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """A whole row as one struct; its fields have names that nothing clashes with."""
    return F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def unpacked(docs: DataFrame, row: str) -> list[Column]:
    """The columns of ``docs`` again from the struct ``row`` of ``packed``."""
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def uniform(*parts: Column | int | str) -> Column:
    """A repeatable number in [0, 1) from the given values."""
    hashed = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(hashed, 11) * F.lit(2.0**-53)


# Rows and bytes that pass between Spark and a Python worker at once: texts may be long.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame, purpose: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Written once to the shared folder and read back. Python functions in ``df`` get small batches."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{purpose}")
    with small_batches(spark, rows):
        write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once everything that reads them has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def runs(rows: Iterator, key) -> Iterator[tuple[object, list]]:
    """Consecutive rows with equal keys, as lists."""
    for value, group in itertools.groupby(rows, key=key):
        yield value, list(group)


def keep_rows(docs: DataFrame, verdicts: DataFrame, key: str, *named: str) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` ``(key, mark, kept)`` keeps.

    ``mark`` is the hash of the columns ``named``; with the key it names a document. Of rows
    that repeat both, all stay, none, or one: the one whose values, written as
    JSON, come last. Only the names of dropped rows are joined, usually the
    smaller part by far. Columns may have any names and types.
    """
    mark, told_id, told_mark = (free_name(docs, wish) for wish in ("_mark", "_told_id", "_told_mark"))
    marked = docs.withColumn(mark, F.xxhash64(*[column(c) for c in named]))
    told = verdicts.groupBy(column(key).alias(told_id), F.col("mark").alias(told_mark)).agg(
        F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    # Names of which some rows stay and some go: rows that repeat key and text.
    partly = stored(told.where("stay > 0 AND stay < n").select(told_id, told_mark), "partly")
    gone = stored(told.where("stay = 0 OR stay < n").select(told_id, told_mark), "gone")
    same = column(key).eqNullSafe(F.col(told_id)) & (F.col(mark) == F.col(told_mark))
    whole = marked.join(gone, same, "left_anti").select(*[column(c) for c in docs.columns])
    if partly.isEmpty():
        return whole
    row = packed(docs)
    found = marked.join(partly, same).select(F.col(told_id), F.col(told_mark), row.alias("row")).groupBy(told_id, told_mark).agg(
        F.max_by("row", F.to_json("row")).alias("row"))
    return whole.unionByName(found.select(*unpacked(docs, "row")))
