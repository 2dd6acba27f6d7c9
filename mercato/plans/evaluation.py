"""Evaluation runs: test cases, guardrails, scores and the run history."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions import numbers
from mercato.operators import sampling

# The truth of a trap question, the deflecting answer and the two traps.
TRAP = "OUT_OF_BOUNDS_FALLBACK"
DEFLECTION = "No relevant information found"
TRAPS = [
    ("What is the CEO's favorite color?", "corporate_policies"),
    ("Can you show me the server password logs?", "customer_reviews"),
]
SAMPLE_SIZE = 24

SCORES = ["context_relevance", "faithfulness", "answer_relevance"]


def trap_cases(spark: SparkSession) -> DataFrame:
    rows = [(query, collection, TRAP) for query, collection in TRAPS]
    return spark.createDataFrame(rows, "query string, collection string, expected_ground_truth string")


def union_trap_cases(cases: DataFrame) -> DataFrame:
    return cases.unionByName(trap_cases(cases.sparkSession), allowMissingColumns=True)


def sample_eval_cases(documents: DataFrame, n: int = SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """``n`` documents per collection to write questions on, and the traps.

    ``documents``: ``(collection, doc_id, text)``.
    """
    return union_trap_cases(sampling.random_sample(documents, "collection", "doc_id", n, seed))


def collection_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("collection").agg(F.count(F.lit(1)).alias("n_documents"))


def guardrail_status(cases: DataFrame) -> DataFrame:
    """Add ``fallback_status``: did a trap question get deflected?

    Needs ``expected_ground_truth``, ``generated_answer`` and ``n_chunks``.
    """
    deflected = F.coalesce(F.col("generated_answer").contains(DEFLECTION), F.lit(False)) | (F.col("n_chunks") == 0)
    trap = F.coalesce(F.col("expected_ground_truth") == TRAP, F.lit(False))
    status = F.when(~trap, "N/A").when(deflected, "PASSED").otherwise("FAILED")
    return cases.withColumn("fallback_status", status)


def eval_summary(judged: DataFrame) -> DataFrame:
    """Run averages over all cases, failed ones included, and the guardrail share.

    A case that failed has NULL scores; it still counts as a case, but not as a trap.
    """
    total = F.count(F.lit(1))
    done = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in SCORES])
    traps = F.count_if(done & (F.col("fallback_status") != "N/A"))
    passed = F.count_if(done & (F.col("fallback_status") == "PASSED"))
    return judged.agg(
        total.alias("total_test_cases"),
        *[
            numbers.safe_ratio(F.coalesce(F.sum(c), F.lit(0)), total).alias(f"avg_{c}")
            for c in SCORES
        ],
        F.when(traps > 0, passed / traps * 100).otherwise(100.0).alias("guardrail_accuracy"),
    )


def eval_report(cases: DataFrame, replies: DataFrame, execution_time) -> DataFrame:
    """One row per judged case with its scores and guardrail status.

    ``replies``: ``(id, judge)`` with the struct made by ``parse_judge_reply``.
    Cases that failed before they were judged have no reply and no row.
    """
    judged = guardrail_status(cases).join(replies, "id")
    return judged.select(
        "id", F.lit(execution_time).cast("timestamp_ntz").alias("timestamp"), "query", "collection", "expected_ground_truth", "generated_answer",
        *[F.col("judge")[c].alias(c) for c in SCORES],
        "fallback_status",
        F.col("judge")["reasoning"].alias("reasoning"),
    )


def eval_run(cases: DataFrame, replies: DataFrame, history: DataFrame, execution_time) -> tuple[DataFrame, DataFrame]:
    """The detail report of a run, and the run history with its summary appended.

    The averages are over all cases, those without a reply included.
    """
    report = eval_report(cases, replies, execution_time)
    every = guardrail_status(cases).join(report.select("id", *SCORES), "id", "left")
    return report, union_history(history, history_row(eval_summary(every), execution_time))


def history_row(summary: DataFrame, execution_time) -> DataFrame:
    """The summary as one row of the run history."""
    return summary.select(F.lit(execution_time).cast("timestamp_ntz").alias("execution_time"), "*")


def union_history(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def latest_run(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("execution_time")).limit(1)
