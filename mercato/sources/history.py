"""The history of evaluation runs, one Parquet partition per run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.schemas import RUN_HISTORY

RUN = "run_id"


def append_run(run: DataFrame, path: str) -> None:
    """Add runs; writing the same run again replaces it and touches no other."""
    keyed = run.withColumn(RUN, F.date_format("execution_time", "yyyyMMdd'T'HHmmssSSSSSS"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; none when the history does not exist yet."""
    try:
        return spark.read.schema(RUN_HISTORY).parquet(path).drop(RUN)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_HISTORY)
