"""The supplied test tables seen as the retail tables (formulas: FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


class Retail:
    """The retail tables of one store; each is set up when first asked for.

    ``fine_categories`` uses type and brand as the category, which gives many
    sparse series in place of a few dense ones.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, fine_categories: bool = False):
        self._spark, self._dir = spark, sf_dir
        self._category = F.concat_ws("_", "p_type", "p_brand") if fine_categories else F.col("p_type")

    def _table(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)

    @property
    def _nation(self) -> DataFrame:
        # One row per key by construction, so the join vanishes where no city is asked for.
        return self._table("nation").groupBy("n_nationkey").agg(F.min("n_name").alias("n_name"))

    @cached_property
    def orders(self) -> DataFrame:
        shipped = self._table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
        )
        delivered = F.col("order_status") == "delivered"
        promised_days = F.substring("o_orderpriority", 1, 1).cast("int") * 300
        return (
            self._table("orders")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                F.when(F.col("o_orderstatus") == "F", "delivered")
                .when(F.col("o_orderstatus") == "O", "shipped")
                .otherwise("processing")
                .alias("order_status"),
                F.col("o_orderdate").alias("order_purchase_timestamp"),
                F.col("o_orderdate").alias("order_approved_at"),
                (F.col("o_orderdate") + F.make_dt_interval(promised_days)).alias("order_estimated_delivery_date"),
            )
            .join(shipped, "order_id", "left")
            .select(
                "order_id",
                "customer_id",
                "order_status",
                "order_purchase_timestamp",
                "order_approved_at",
                F.when(delivered, F.col("first_ship")).alias("order_delivered_carrier_date"),
                F.when(delivered, F.col("last_ship")).alias("order_delivered_customer_date"),
                "order_estimated_delivery_date",
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            money("l_extendedprice").alias("price"),
            (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)"))
            .cast("decimal(18,4)")
            .alias("freight_value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self._table("part").select(
            F.col("p_partkey").alias("product_id"),
            self._category.alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            (size * F.lit(100.0)).alias("product_weight_g"),
            size.cast("double").alias("product_length_cm"),
            (size % 7 + 1).cast("double").alias("product_height_cm"),
            (size % 5 + 1).cast("double").alias("product_width_cm"),
        )

    @cached_property
    def translation(self) -> DataFrame:
        name = F.replace("product_category_name", F.lit("#"), F.lit(""))
        return (
            self._table("part")
            .where(F.col("p_type") != "PROMO")
            .select(self._category.alias("product_category_name"))
            .distinct()
            .withColumn("product_category_name_english", F.concat(F.lower(name), F.lit("_goods")))
        )

    @cached_property
    def sellers(self) -> DataFrame:
        state = F.col("s_nationkey")
        return self._table("supplier").join(self._nation, state == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.lpad(state.cast("string"), 5, "0").alias("seller_zip_code_prefix"),
            F.col("n_name").alias("seller_city"),
            state.cast("string").alias("seller_state"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        state = F.col("c_nationkey")
        return self._table("customer").join(self._nation, state == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.lpad(state.cast("string"), 5, "0").alias("customer_zip_code_prefix"),
            F.col("n_name").alias("customer_city"),
            state.cast("string").alias("customer_state"),
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        return self._table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            money("o_totalprice").alias("payment_value"),
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        event_type = F.col("event_type")
        return self._table("events").select(
            F.col("event_id").alias("review_id"),
            F.floor(F.col("event_id") / 2).alias("order_id"),
            (F.least(F.lit(4), F.floor(F.col("value") / 30)).cast("int") + 1).alias("review_score"),
            F.when(event_type != "click", F.col("props")).alias("review_comment_title"),
            F.when(event_type != "error", event_type).alias("review_comment_message"),
        )


def bind(spark: SparkSession, sf_dir: str, fine_categories: bool = False) -> Retail:
    return Retail(spark, sf_dir, fine_categories)
