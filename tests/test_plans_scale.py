"""What the physical plans of the marts look like over stored retail tables."""

import re
from types import SimpleNamespace

import pytest
from shop import store

from mercato.operators import sampling
from mercato.plans import churn, delivery, demand, metrics, retrieval
from mercato.sources.files import write_bucketed


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The small store as Parquet tables, without broadcast joins, as large tables would be joined."""
    root = tmp_path_factory.mktemp("store")
    tables = {}
    for name, df in vars(store(spark)).items():
        df.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield SimpleNamespace(**tables)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(text, table):
    return [line for line in text.splitlines() if "FileScan" in line and f"/{table}]" in line]


def test_status_filter_reaches_the_files(stored):
    for line in scan_of(plan(metrics.revenue(stored)), "orders"):
        assert "EqualTo(order_status,delivered)" in line


def test_only_needed_columns_are_read(stored):
    text = plan(metrics.revenue(stored))
    assert all(line.endswith("ReadSchema: struct<order_id:string,price:decimal(12,2)>") for line in scan_of(text, "order_items"))
    assert all(line.endswith("ReadSchema: struct<order_id:string,order_status:string>") for line in scan_of(text, "orders"))


@pytest.mark.parametrize("build", [
    delivery.delivery_features, churn.churn_profile, metrics.revenue_share_by_city, metrics.repeat_rate_basket,
    metrics.customer_deviation, metrics.seasonal_anomaly, metrics.top_categories_revenue,
    lambda r: demand.weekly_features(demand.daily_category_sales(r)),
    lambda r: demand.next_week_features(demand.daily_category_sales(r)),
])
def test_no_nested_loops_and_no_window_over_everything(stored, build):
    text = plan(build(stored))
    assert "NestedLoop" not in text and "Cartesian" not in text
    for line in text.splitlines():
        if "Window [" in line:
            assert not re.search(r"windowspecdefinition\((?:\w+#\d+L? (?:ASC|DESC)|specifiedwindowframe)", line), line


def test_items_are_summed_before_they_move(stored):
    """Below the exchange on the orders' key there is a partial aggregate of the items."""
    for df, keys in ((churn.churn_profile(stored), "order_id"), (delivery.delivery_features(stored), "seller_state")):
        lines = plan(df).splitlines()
        moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and keys in line and "Aggregate" in lines[i + 1]]
        assert moved and all("partial_" in lines[i + 1] for i in moved)


def test_top_k_is_cut_before_the_shuffle(spark, stored):
    sample = sampling.random_sample(stored.order_items, "seller_id", "order_id", 3)
    assert plan(sample).count("WindowGroupLimit") == 4
    scored = spark.createDataFrame([(1, "a", 0, 5)], "query_id int, doc_id string, seen int, score int")
    assert plan(retrieval.rerank(scored)).count("WindowGroupLimit") == 2


def test_bucketed_tables_meet_without_a_shuffle(spark, stored, tmp_path):
    names = ["orders", "order_items", "order_reviews"]
    bucketed = {n: write_bucketed(getattr(stored, n), f"b_{n}", str(tmp_path / n), ["order_id"], 4) for n in names}
    try:
        found = churn.order_reviews(SimpleNamespace(**bucketed))
        assert "Exchange" not in plan(found) and "Exchange" in plan(churn.order_reviews(stored))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, churn.order_reviews(stored).collect()))
    finally:
        for n in names:
            spark.sql(f"DROP TABLE b_{n}")


def test_whole_stage_codegen_covers_the_joins(stored):
    text = plan(metrics.revenue(stored))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
