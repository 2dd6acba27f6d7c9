"""Queries that write the supplied tables somewhere and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.binding import bind, table
from mercato.plans import evaluation
from mercato.registry.base import part, query
from mercato.registry.texts import cases
from mercato.session import scratch_path
from mercato.sources import files, history, vectors


@query("src_csv", "SELECT * FROM documents")
def src_csv(spark, d):
    """Whole texts, with their quotes and line breaks, through CSV files."""
    docs = table(spark, d, "documents")
    path = files.write_csv(docs, scratch_path(spark, "documents.csv"))
    return files.read_csv(spark, path, docs.schema, multiline=True)


@query("sink_csv", "SELECT order_id, purchase_month, is_delayed, total_freight_value FROM features")
def sink_csv(spark, d):
    from mercato.plans.delivery import delivery_features

    rows = delivery_features(bind(spark, d)).select("order_id", "purchase_month", "is_delayed", "total_freight_value")
    path = files.write_csv(rows, scratch_path(spark, "features.csv"))
    return files.read_csv(spark, path, rows.schema)


@query("src_manifest", """
SELECT 'orders' AS table_name, count(*) AS n_rows, 'loaded' AS status FROM orders
UNION ALL SELECT 'lineitem', count(*), 'loaded' FROM lineitem
UNION ALL SELECT 'events', NULL, 'failed' UNION ALL SELECT 'returns', NULL, 'missing'
""")
def src_manifest(spark, d):
    """Two good tables, one whose files do not fit the schema, and a missing one."""
    root = scratch_path(spark, "raw")
    manifest = {}
    for name in ("orders", "lineitem", "events"):
        rows = table(spark, d, name)
        path = files.write_csv(rows, f"{root}/{name}.csv")
        manifest[path] = (name, "event_id date, ts int" if name == "events" else rows.schema)
    manifest[f"{root}/returns.csv"] = ("returns", "order_id long")
    return files.ingest_manifest(spark, manifest, f"{root}/tables").drop("message")


@query("sink_overwrite", "SELECT * FROM customer")
def sink_overwrite(spark, d):
    """Written twice; the second table replaces the first."""
    path = scratch_path(spark, "customer")
    rows = table(spark, d, "customer")
    files.write_table(rows.unionByName(rows), path)
    files.write_table(rows, path)
    return spark.read.parquet(path)


@query("src_table", """
SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1
""")
def src_table(spark, d):
    return files.run_sql(
        spark,
        "SELECT c_mktsegment, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,4))) AS double) AS total "
        "FROM store_orders JOIN store_customers ON o_custkey = c_custkey WHERE o_orderstatus = :status GROUP BY 1",
        {"store_orders": table(spark, d, "orders"), "store_customers": table(spark, d, "customer")},
        status="F",
    )


@query("src_json", "SELECT query, collection, expected_ground_truth FROM cases")
def src_json(spark, d):
    from mercato.schemas import EVAL_CASE

    rows = cases(spark, d).select(*EVAL_CASE.fieldNames())
    return files.read_json(spark, files.write_json(rows, scratch_path(spark, "cases.json")), EVAL_CASE)


@query("sink_json", "SELECT id, collection, fallback_status FROM guarded")
def sink_json(spark, d):
    rows = evaluation.guardrail_status(cases(spark, d)).select("id", "collection", "fallback_status")
    return files.read_json(spark, files.write_json(rows, scratch_path(spark, "report.json")), rows.schema)


# One evaluation run per day of events.
part("runs", """
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS execution_time, count(*) AS total_test_cases,
       avg(user_id) AS avg_context_relevance, avg(user_id * 2) AS avg_faithfulness, avg(user_id * 3) AS avg_answer_relevance,
       count(*) FILTER (event_type = 'view') * 100.0::DOUBLE / count(*) AS guardrail_accuracy
FROM events GROUP BY 1
""")


def runs(spark, d):
    share = F.count_if(F.col("event_type") == "view") * F.lit(100.0) / F.count(F.lit(1))
    user = F.col("user_id")
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("timestamp_ntz").alias("execution_time")).agg(
        F.count(F.lit(1)).alias("total_test_cases"),
        F.avg(user).alias("avg_context_relevance"),
        F.avg(user * 2).alias("avg_faithfulness"),
        F.avg(user * 3).alias("avg_answer_relevance"),
        share.alias("guardrail_accuracy"),
    )


@query("sink_append_history", "SELECT * FROM runs")
def sink_append_history(spark, d):
    """All runs, after the early ones were already there."""
    path = scratch_path(spark, "history")
    every = runs(spark, d)
    early = every.agg(F.min("execution_time") + F.expr("interval 3 days")).scalar()
    history.append_run(every.where(F.col("execution_time") < early), path)
    history.append_run(every, path)
    return history.read_history(spark, path)


@query("union_history", """
SELECT execution_time, total_test_cases, CASE WHEN total_test_cases > 300 THEN avg_faithfulness END AS avg_faithfulness FROM runs
""")
def union_history(spark, d):
    """Old runs lack a column that the new ones have."""
    every = runs(spark, d).select("execution_time", "total_test_cases", "avg_faithfulness")
    new = F.col("total_test_cases") > 300
    return evaluation.union_history(every.where(new), every.where(~new).drop("avg_faithfulness"))


@query("latest_run", "SELECT * FROM runs ORDER BY execution_time DESC LIMIT 1")
def latest_run(spark, d):
    return evaluation.latest_run(runs(spark, d))


def collection(spark, d):
    """Every document, with its vector where there is one."""
    return table(spark, d, "documents").join(
        table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id"), "left"
    ).select(
        F.concat(F.lit("policy_chunk_"), F.col("doc_id").cast("string")).alias("id"),
        "embedding", "text", F.struct("source", F.col("lang").alias("header")).alias("metadata"),
    )


COLLECTION_SQL = "FROM documents LEFT JOIN embeddings ON vec_id = doc_id"


@query("sink_vectors", f"SELECT 'policy_chunk_' || doc_id AS id, text, source, lang AS header, len(embedding)::INTEGER AS dims {COLLECTION_SQL}")
def sink_vectors(spark, d):
    """A collection written, then added to with rows it mostly has."""
    path = scratch_path(spark, "collection")
    rows = collection(spark, d)
    vectors.recreate_collection(rows.where(F.col("metadata.header") != "en"), path)
    vectors.add_to_collection(rows, path)
    return vectors.read_collection(spark, path).select(
        "id", "text", "metadata.source", "metadata.header", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")
    )


@query("scan_vectors", f"SELECT text {COLLECTION_SQL}")
def scan_vectors(spark, d):
    path = vectors.recreate_collection(collection(spark, d), scratch_path(spark, "collection"))
    return vectors.scan_texts(spark, path)
