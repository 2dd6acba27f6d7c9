"""A refreshed mart equals one that is built anew."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from mercato.plans.refresh import DailyMart

ORDERS = "order_id long, order_status string, order_purchase_timestamp timestamp_ntz"
ITEMS = "order_id long, order_item_id int, product_id long, price decimal(12,2)"


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    orders = [(i, rng.choice(["delivered", "delivered", "shipped"]), start + dt.timedelta(days=rng.randrange(200), hours=3)) for i in range(300)]
    items = [(i, n, rng.randrange(12), decimal.Decimal(rng.randrange(1, 9999)) / 100) for i in range(300) for n in range(rng.randint(0, 4))]
    names = [(p, f"c{p % 4}") for p in range(10)]
    return orders, items, spark.createDataFrame(names, "product_id long, category string")


def rows(mart):
    return sorted(map(tuple, mart.daily.collect()))


def built(spark, path, orders, items, names):
    return DailyMart(spark, path).build(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(items, ITEMS), names)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_the_orders_ends_alike(spark, shop, tmp_path, seed):
    orders, items, names = shop
    rng = random.Random(seed)
    first = [o for o in orders if rng.random() < 0.6]
    late = [o for o in orders if o not in first]
    # Some orders were known in another state, with other items.
    before = [(i, "shipped" if s == "delivered" else "delivered", t) if i % 5 == 0 else (i, s, t) for i, s, t in first]
    old = [(i, n, p, x + 1) if i % 5 == 0 else (i, n, p, x) for i, n, p, x in items]
    changed = late + [o for o in first if o[0] % 5 == 0]
    full = built(spark, str(tmp_path / "full"), orders, items, names)
    mart = built(spark, str(tmp_path / "mart"), before, old, names)
    assert rows(mart) != rows(full)
    everything = spark.createDataFrame(items, ITEMS)
    half = len(changed) // 2
    for part in (changed[:half], changed[half:], changed[half:]):
        mart.refresh(spark.createDataFrame(part, ORDERS), everything, names)
    assert rows(mart) == rows(full)
    assert sorted(map(tuple, mart.state.collect())) == sorted(map(tuple, full.state.collect()))


def test_only_changed_months_are_read_and_replaced(spark, shop, tmp_path):
    orders, items, names = shop
    mart = built(spark, str(tmp_path / "m"), orders, items, names)
    stamps = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "m" / "state").glob("month=*/*.parquet")}
    before = stamps()
    march = [o for o in orders if o[2].month == 3]
    changed = spark.createDataFrame([(i, "shipped", t) for i, _, t in march], ORDERS)
    plan = mart.touched(["2024-03"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-03" in plan.split("PartitionFilters")[1].split("]")[0]
    assert mart.refresh(changed, spark.createDataFrame(items, ITEMS), names) == ["2024-03"]
    after = stamps()
    assert "month=2024-03" not in after and {m: t for m, t in before.items() if m != "month=2024-03"} == after
    assert mart.daily.where(F.col("month") == "2024-03").isEmpty()


def test_empty_changes_and_tables(spark, shop, tmp_path):
    orders, items, names = shop
    mart = built(spark, str(tmp_path / "m"), [], [], names)
    assert rows(mart) == []
    assert mart.refresh(spark.createDataFrame([], ORDERS), spark.createDataFrame([], ITEMS), names) == []
    mart.refresh(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(items, ITEMS), names)
    assert rows(mart) == rows(built(spark, str(tmp_path / "full"), orders, items, names))
