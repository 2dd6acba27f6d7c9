"""Text to unit vectors with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

DIMENSIONS = 256


def fit_embedder(corpus: DataFrame, column: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """Hashed word counts weighted by rarity, scaled to length 1."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]).fit(corpus.select(column))


def embed_text(model: PipelineModel, rows: DataFrame, out: str = "embedding") -> DataFrame:
    embedded = model.transform(rows).withColumn(out, vector_to_array("_unit", dtype="float32"))
    return embedded.select(*rows.columns, out)
