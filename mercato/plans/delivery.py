"""Delivery-delay features per order, and the seller delay rates behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.binding import Retail
from mercato.functions import dates, numbers

FEATURES = [
    "estimated_days_to_deliver", "total_freight_value", "total_weight_g", "total_volume_cm3",
    "purchase_month", "purchase_day_of_week", "seller_historical_delay_rate",
]
BINARY_FEATURES = ["is_interstate"]
LABEL = "is_delayed"


def is_delivered() -> Column:
    return F.col("order_status") == "delivered"


def is_dated() -> Column:
    """Delivered, with both dates known."""
    return (
        is_delivered()
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("order_estimated_delivery_date").isNotNull()
    )


def delayed_flag() -> Column:
    """1 when delivered after the estimate; a missing date counts as 0."""
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return F.when(late, 1).otherwise(0)


def interstate_flag() -> Column:
    return F.when(F.col("customer_state") != F.col("seller_state"), 1).otherwise(0)


def filter_delivered(orders: DataFrame) -> DataFrame:
    return orders.where(is_dated())


def seller_delay_stats(
    orders: DataFrame, items: DataFrame, delivered_only: bool = True, distinct_orders: bool = False
) -> DataFrame:
    """Order rows and late order rows per seller.

    An order with several items of a seller counts once per item, as in the
    training data; ``distinct_orders`` counts it once. ``delivered_only=False``
    is the form used when serving.
    """
    scope = filter_delivered(orders) if delivered_only else orders
    flagged = scope.select("order_id", delayed_flag().alias(LABEL))
    sold = items.select("order_id", "seller_id")
    if distinct_orders:
        sold = sold.distinct()
    return (
        sold.join(flagged, "order_id")
        .groupBy("seller_id")
        .agg(F.count("order_id").alias("total_orders"), F.sum(LABEL).alias("delayed_orders"))
    )


def seller_delay_rates(stats: DataFrame) -> DataFrame:
    rate = numbers.safe_ratio(F.col("delayed_orders"), F.col("total_orders"))
    return stats.select("seller_id", rate.alias("delay_rate"))


def seller_rates_before(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Delay rate of a seller over deliveries before the day of a purchase.

    Rows ``(seller_id, purchase_day, delay_rate)`` for every day on which a
    seller sold something. Items are summed per seller and day first, so the
    running sums see at most one row per calendar day.
    """
    sold = items.select("order_id", "seller_id").join(
        filter_delivered(orders).select(
            "order_id",
            F.to_date("order_delivered_customer_date").alias("delivered_on"),
            F.to_date("order_purchase_timestamp").alias("bought_on"),
            delayed_flag().alias(LABEL),
        ),
        "order_id",
    )
    one, zero = F.lit(1), F.lit(0)
    both = F.array(
        F.struct(F.col("delivered_on").alias("day"), one.alias("n"), F.col(LABEL).alias("late"), zero.alias("asked")),
        F.struct(F.col("bought_on").alias("day"), zero.alias("n"), zero.alias("late"), one.alias("asked")),
    )
    by_day = sold.select("seller_id", F.inline(both)).groupBy("seller_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("n", "late", "asked")]
    )
    earlier = Window.partitionBy("seller_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rate = numbers.safe_ratio(F.sum("late").over(earlier), F.sum("n").over(earlier))
    return by_day.withColumn("delay_rate", rate).where(F.col("asked") > 0).select(
        "seller_id", F.col("day").alias("purchase_day"), "delay_rate"
    )


def _sum_lines(lines: DataFrame) -> DataFrame:
    """One row per order and seller state.

    Summing before the join with the orders leaves at most one row per state
    of an order, so an order with very many items stays small.
    """
    return lines.groupBy("order_id", "seller_state").agg(
        numbers.money_sum(F.col("freight_value")).alias("total_freight_value"),
        F.sum("product_weight_g").alias("total_weight_g"),
        F.sum("volume").alias("total_volume_cm3"),
        F.max("delay_rate").alias("seller_historical_delay_rate"),
    )


def _measured(items: DataFrame, products: DataFrame) -> DataFrame:
    volume = numbers.volume(F.col("product_length_cm"), F.col("product_height_cm"), F.col("product_width_cm"))
    sizes = products.select("product_id", "product_weight_g", volume.alias("volume"))
    return items.select("order_id", "product_id", "seller_id", "freight_value").join(sizes, "product_id")


def order_lines(items: DataFrame, products: DataFrame, sellers: DataFrame, rates: DataFrame) -> DataFrame:
    """Item measures and seller delay rates per order and seller state."""
    rated = sellers.select("seller_id", "seller_state").join(rates, "seller_id", "left")
    return _sum_lines(_measured(items, products).join(rated, "seller_id"))


def order_lines_before(r: Retail) -> DataFrame:
    """The same with the rates known before the day of the purchase."""
    days = filter_delivered(r.orders).select("order_id", F.to_date("order_purchase_timestamp").alias("purchase_day"))
    lines = _measured(r.order_items, r.products).join(r.sellers.select("seller_id", "seller_state"), "seller_id")
    rates = seller_rates_before(r.orders, r.order_items)
    return _sum_lines(lines.join(days, "order_id").join(rates, ["seller_id", "purchase_day"], "left"))


def _features(orders: DataFrame, lines: DataFrame, customers: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    dated = orders.select(
        "order_id",
        "customer_id",
        dates.month_of(bought).alias("purchase_month"),
        dates.day_of_week(bought).alias("purchase_day_of_week"),
        dates.calendar_days(F.col("order_estimated_delivery_date"), bought).alias("estimated_days_to_deliver"),
        delayed_flag().alias(LABEL),
    ).join(customers.select("customer_id", "customer_state"), "customer_id")
    return dated.join(lines, "order_id").select(
        "order_id",
        "purchase_month",
        "purchase_day_of_week",
        "estimated_days_to_deliver",
        LABEL,
        "total_freight_value",
        "total_weight_g",
        "total_volume_cm3",
        interstate_flag().alias("is_interstate"),
        "seller_historical_delay_rate",
        "seller_state",
    )


def delivery_features(r: Retail, point_in_time: bool = False) -> DataFrame:
    """Training rows: one per delivered order and seller state.

    As in the training data, a seller's delay rate covers all its deliveries,
    later ones and the order itself included. ``point_in_time`` takes only
    deliveries before the day of the purchase, and NULL where there are none.
    """
    if point_in_time:
        lines = order_lines_before(r)
    else:
        rates = seller_delay_rates(seller_delay_stats(r.orders, r.order_items))
        lines = order_lines(r.order_items, r.products, r.sellers, rates)
    return _features(filter_delivered(r.orders), lines, r.customers).drop("seller_state")


def serving_features(r: Retail, order_ids: DataFrame) -> DataFrame:
    """Features of the asked orders, one row each, in any state of delivery.

    ``order_ids`` has the column ``order_id``. Only the sellers of these orders
    go into the delay rates. An order served from several states keeps the row
    of the first state; an unknown order comes back with ``found = false``.
    """
    asked = order_ids.select("order_id").distinct()
    items = r.order_items.join(asked, "order_id", "left_semi")
    same_sellers = r.order_items.join(items.select("seller_id").distinct(), "seller_id", "left_semi")
    rates = seller_delay_rates(seller_delay_stats(r.orders, same_sellers, delivered_only=False))
    lines = order_lines(items, r.products, r.sellers, rates)
    rows = _features(r.orders.join(asked, "order_id", "left_semi"), lines, r.customers).drop(LABEL)
    kept = [c for c in rows.columns if c not in ("order_id", "seller_state")]
    first = rows.groupBy("order_id").agg(F.min_by(F.struct(*kept), F.col("seller_state")).alias("_row"))
    return asked.join(first, "order_id", "left").select(
        "order_id", F.col("_row").isNotNull().alias("found"), "_row.*"
    )


def baseline_delay_rate(features: DataFrame) -> DataFrame:
    """Share of late rows, in percent."""
    return features.agg((F.avg(LABEL) * 100).alias("baseline_delay_rate"))


# The risk threshold and the labels on both sides of it.
RISK_THRESHOLD = 0.75
HIGH_RISK = ("High Risk of Delay", "Upgrade to Expedited Shipping.")
LOW_RISK = ("On Track", "Standard Processing.")


def risk_threshold(scored: DataFrame, probability: str, threshold: float = RISK_THRESHOLD) -> DataFrame:
    """Label a probability; a row without one has the status ``error``."""
    p = F.col(probability)
    high = p >= threshold
    return scored.withColumns({
        "status": F.when(p.isNotNull(), "success").otherwise("error"),
        "delay_probability": numbers.percent_label(p),
        "risk_level": F.when(high, HIGH_RISK[0]).when(p.isNotNull(), LOW_RISK[0]),
        "recommendation": F.when(high, HIGH_RISK[1]).when(p.isNotNull(), LOW_RISK[1]),
    })


# What a what-if question leaves out.
SCENARIO_DEFAULTS = {
    "estimated_days_to_deliver": 11,
    "total_freight_value": 20.0,
    "purchase_month": 6,
    "purchase_day_of_week": 2,
    "seller_historical_delay_rate": 0.08,
}
SCENARIO_REQUIRED = ["total_weight_g", "total_volume_cm3", "is_interstate"]


def scenario_defaults(scenarios: DataFrame) -> DataFrame:
    """Fill in what-if rows; ``valid`` is false where a required feature is missing."""
    valid = F.lit(True)
    for column in SCENARIO_REQUIRED:
        valid = valid & F.col(column).isNotNull()
    return scenarios.na.fill(SCENARIO_DEFAULTS).withColumn("valid", valid)
