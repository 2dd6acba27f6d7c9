"""The daily demand mart, kept up to date from change sets.

Beside the mart lies one row per order and category with its sums (its state).
Both are partitioned by the month of the purchase, which an order never
changes. A refresh reads and replaces the partitions of the months that the
changed orders were bought in, and no others.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.plans.delivery import is_delivered
from mercato.plans.demand import KEY
from mercato.sources.files import materialize

MONTH = "month"
STATE = f"order_id long, sale_date date, {KEY} string, units_sold long, revenue decimal(18,4), {MONTH} string"
MART = f"sale_date date, {KEY} string, units_sold long, daily_revenue double, {MONTH} string"


def order_sums(orders: DataFrame, items: DataFrame, names: DataFrame) -> DataFrame:
    """Units and revenue of each delivered order by category: partial sums that add up in any grouping.

    ``names`` has ``(product_id, category)``; items without a category drop out.
    """
    sold = orders.where(is_delivered()).select(
        F.col("order_id").cast("long").alias("order_id"), F.to_date("order_purchase_timestamp").alias("sale_date"))
    lines = items.select(F.col("order_id").cast("long").alias("order_id"), "product_id", "price").join(sold, "order_id").join(names, "product_id")
    return lines.groupBy("order_id", "sale_date", KEY).agg(
        F.count(F.lit(1)).alias("units_sold"), F.sum(F.col("price").cast("decimal(18,4)")).cast("decimal(18,4)").alias("revenue")
    ).withColumn(MONTH, F.date_format("sale_date", "yyyy-MM"))


def daily_sums(state: DataFrame) -> DataFrame:
    return state.groupBy("sale_date", KEY, MONTH).agg(
        F.sum("units_sold").alias("units_sold"), F.sum("revenue").cast("double").alias("daily_revenue")
    ).select("sale_date", KEY, "units_sold", "daily_revenue", MONTH)


@dataclasses.dataclass
class DailyMart:
    """Two partitioned tables below ``path``; ``refresh`` may be repeated with the same changes."""

    spark: SparkSession
    path: str

    @property
    def state(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state")

    @property
    def daily(self) -> DataFrame:
        return self.spark.read.schema(MART).parquet(f"{self.path}/daily")

    def build(self, orders: DataFrame, items: DataFrame, names: DataFrame) -> DailyMart:
        """All months anew."""
        self._replace(order_sums(orders, items, names).select(*self._columns(STATE)), "state", "static")
        self._replace(daily_sums(self.state), "daily", "static")
        return self

    def refresh(self, changed: DataFrame, items: DataFrame, names: DataFrame) -> list[str]:
        """Put the ``changed`` orders, new and altered ones, in place of what the mart knows of them.

        ``items`` need to hold only the items of these orders. An order that is
        no longer delivered, or has lost its items, leaves the sums; months
        that lose their last order become empty. Returns the months replaced.
        """
        ids = changed.select(F.col("order_id").cast("long").alias("order_id"), F.date_format("order_purchase_timestamp", "yyyy-MM").alias(MONTH))
        months = sorted(r[MONTH] for r in ids.select(MONTH).distinct().collect() if r[MONTH] is not None)
        if not months:
            return []
        kept = self.touched(months).join(ids.select("order_id"), "order_id", "left_anti")
        fresh = order_sums(changed, items.join(changed.select("order_id"), "order_id", "left_semi"), names)
        # Written aside first: the partitions that are read are about to be replaced.
        state = materialize(kept.select(*self._columns(STATE)).unionByName(fresh.select(*self._columns(STATE))), "state")
        self._replace(state, "state", "dynamic", months)
        self._replace(daily_sums(state), "daily", "dynamic", months)
        return months

    def touched(self, months: list[str]) -> DataFrame:
        return self.state.where(F.col(MONTH).isin(months))

    @staticmethod
    def _columns(schema: str) -> list[str]:
        return [c.split()[0] for c in schema.split(", ")]

    def _replace(self, df: DataFrame, table: str, mode: str, months: list[str] = ()) -> None:
        # Rows of a month meet in few files; a month with a third of all rows is still split by its keys.
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(spread, MONTH, F.pmod(F.xxhash64("sale_date", KEY), F.lit(4)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(MONTH).parquet(f"{self.path}/{table}")
        # A month without rows writes no partition, so what it held is deleted.
        if months:
            written = {r[MONTH] for r in df.select(MONTH).distinct().collect()}
            for month in set(months) - written:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{MONTH}={month}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
