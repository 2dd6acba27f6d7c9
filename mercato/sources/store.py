"""The retail store as ingested: declared tables in, the object the marts work on out."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from mercato import schemas
from mercato.sources import files

# The marts call the translation table by a shorter name.
SHORT = {"product_category_name_translation": "translation"}


def ingest_store(spark: SparkSession, paths: dict[str, str], target: str, multiline: bool = False) -> DataFrame:
    """Load the CSV files of the declared tables (``paths`` by table name) into Parquet tables below ``target``."""
    manifest = {path: (name, schemas.TABLES[name]) for name, path in paths.items()}
    return files.ingest_manifest(spark, manifest, target, multiline)


def open_store(spark: SparkSession, target: str) -> SimpleNamespace:
    """The tables below ``target``, as every function in ``plans`` takes them."""
    return SimpleNamespace(**{
        SHORT.get(name, name): spark.read.schema(schema).parquet(f"{target}/{name}")
        for name, schema in schemas.TABLES.items()
    })
