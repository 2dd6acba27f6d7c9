"""Tables of a remote database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_database(
    spark: SparkSession, url: str, table: str, properties: dict[str, str],
    column: str, lower: int, upper: int, partitions: int,
) -> DataFrame:
    """A table read by ``partitions`` tasks at once, cut by a numeric column.

    Filters and column choices are passed on to the database. The driver class
    of the database must be on the class path.
    """
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties,
    )
