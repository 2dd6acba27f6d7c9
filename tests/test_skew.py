"""The same queries on tables in which one key holds a third of all rows."""

import duckdb
import pytest
from oracle import TABLES, compare, connect

import __spark_entry__ as entry

# Every third row gets the key of the first row.
SKEWED = {
    "lineitem": """
        SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
                          CASE WHEN n % 3 = 1 THEN 1 ELSE l_partkey END AS l_partkey,
                          CASE WHEN n % 3 = 2 THEN 1 ELSE l_suppkey END AS l_suppkey)
        FROM (SELECT *, row_number() OVER () AS n FROM src)""",
    "orders": """
        SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey,
                          CASE WHEN o_orderkey = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM src""",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM src",
    "embeddings": """
        SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM src WHERE vec_id = 0) ELSE embedding END AS embedding)
        FROM src""",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS lang) FROM src",
    "conversations": """
        SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
               row_number() OVER (PARTITION BY CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END ORDER BY conv_id, turn) - 1 AS turn,
               role, text FROM src""",
}
QUERIES = [
    "delivery_features", "delivery_features_point_in_time", "seller_delay_stats", "order_lookup", "churn_profile", "join_left_reviews", "cluster_risk_map",
    "daily_category_sales", "drop_incomplete", "forecast_features", "revenue_share_by_city", "repeat_rate_basket",
    "aov_by_tier", "seasonal_anomaly", "customer_deviation", "profile_table", "random_sample", "dedupe_first_seen",
    "check_primary_key", "check_foreign_key", "chunk_pages", "title_carry_forward", "src_text_docs", "expand_queries",
    "knn_topk", "cross_vectors", "retrieve_dedupe", "rerank", "build_context", "str_context", "row_index_id",
    "impute_median", "classification_report",
]


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        con.execute(f"COPY ({SKEWED.get(name, 'SELECT * FROM src')}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_under_skew(name, spark, skewed_dir):
    _, problem = compare(spark, connect(skewed_dir), entry.queries()[name], entry.oracle_sql()[name], skewed_dir)
    assert not problem, problem
