"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor
kept; ``run`` writes every result to the shared folder and reads it again. All
but the last return the columns of ``documents``. Columns beyond these are
carried along, except by packing, which returns the places of the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import exact_dedup, mixing, near_duplicates, packing, quality
from mercato.llm.common import stored, table, word_count


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the cutoffs that the labels prove safe."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of 0.8 Jaccard similarity connect, the row with the least id."""
    return near_duplicates.drop_similar(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to three times."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes: ``(doc_id, piece, start, length, bin, capacity, position)``."""
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("length")))


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", unique_texts),
    ("n-gram Jaccard join", distinct_texts),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]

# Binomial cutoffs could be said in SQL, similarity classes and packing not on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
