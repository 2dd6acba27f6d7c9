"""Vector collections: Parquet tables of ``(id, embedding, text, metadata)``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recreate_collection(rows: DataFrame, path: str) -> str:
    """Replace whatever the collection held."""
    rows.write.mode("overwrite").parquet(path)
    return path


def add_to_collection(rows: DataFrame, path: str) -> str:
    """Create the collection if need be and add the rows whose id is new to it; of equal ids the least row."""
    others = [c for c in rows.columns if c != "id"]
    fresh = rows.groupBy("id").agg(F.min(F.struct(*others)).alias("_row")).select("id", "_row.*").select(*rows.columns)
    try:
        known = rows.sparkSession.read.parquet(path).select("id")
        fresh = fresh.join(known, "id", "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)
    return path


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """Only the text column is read from the files."""
    return read_collection(spark, path).select("text")
