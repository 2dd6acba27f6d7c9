"""CSV, JSON and Parquet in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercato import session


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False) -> DataFrame:
    """Headered CSV with declared types.

    ``multiline`` is needed only for texts with line breaks; it makes each file
    one task, so large tables are better read without it.
    """
    return spark.read.schema(schema).csv(
        path, header=True, escape='"', multiLine=multiline, mode="FAILFAST",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Replace the Parquet table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Replace the catalog table ``name``, cut into buckets by its join keys.

    Tables with the same buckets are joined and grouped by these keys without
    a shuffle; worth it for orders, items, payments and reviews by order.
    """
    (
        df.write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def read_json(spark: SparkSession, path: str, schema: StructType | str, array: bool = False) -> DataFrame:
    """JSON lines, or files that each hold one JSON ``array``."""
    return spark.read.schema(schema).json(path, multiLine=array, mode="FAILFAST")


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def ingest_manifest(
    spark: SparkSession, manifest: dict[str, tuple[str, StructType | str]], target: str, multiline: bool = False
) -> DataFrame:
    """Load CSV files into Parquet tables below ``target``.

    ``manifest`` maps a path to ``(table, schema)``. A missing or unreadable
    file does not stop the others, and leaves a table of an earlier load alone:
    rows are read and staged before the table is replaced. Rows
    ``(table_name, n_rows, status, message)``.
    """
    results = []
    for path, (name, schema) in manifest.items():
        try:
            counted = Observation()
            rows = read_csv(spark, path, schema, multiline).observe(counted, F.count(F.lit(1)).alias("n"))
            write_table(materialize(rows, f"staged-{name}"), f"{target}/{name}")
            results.append((name, counted.get["n"], "loaded", None))
        except AnalysisException as problem:
            missing = problem.getCondition() == "PATH_NOT_FOUND"
            results.append((name, None, "missing" if missing else "failed", str(problem)[:500]))
        except Exception as problem:
            results.append((name, None, "failed", str(problem)[:500]))
    return spark.createDataFrame(results, "table_name string, n_rows long, status string, message string")


def run_sql(spark: SparkSession, text: str, views: dict[str, DataFrame], **args) -> DataFrame:
    """A SQL text over the given frames, with ``:name`` parameters."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back; cuts the lineage. ``written_to`` is the path, for ``remove``."""
    spark = df.sparkSession
    out = spark.read.schema(df.schema).parquet(path := write_table(df, session.scratch_path(spark, purpose)))
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, once everything that reads it has been written itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
