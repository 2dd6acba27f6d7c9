"""Business metrics, each with one fixed definition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.binding import Retail
from mercato.functions import dates, numbers
from mercato.plans.delivery import is_delivered
from mercato.plans.demand import KEY, english_items

# Fixed value: "today" of a store without orders.
FALLBACK_TODAY = dt.date(2018, 10, 17)


def _delivered_items(r: Retail, *order_columns: str) -> DataFrame:
    return r.order_items.join(r.orders.where(is_delivered()).select("order_id", *order_columns), "order_id")


def order_value() -> Column:
    return F.col("price") + F.col("freight_value")


def revenue(r: Retail) -> DataFrame:
    """Item prices of delivered orders."""
    return _delivered_items(r).agg(numbers.money_sum(F.col("price")).alias("revenue"))


def total_order_value(r: Retail) -> DataFrame:
    """Prices plus freight of all items."""
    return r.order_items.agg(numbers.money_sum(order_value()).alias("total_order_value"))


def english_category(r: Retail) -> DataFrame:
    """Products under the English name of their category."""
    return r.products.join(r.translation, "product_category_name").select(
        "product_id", F.col("product_category_name_english").alias(KEY)
    )


def delivery_time_days(r: Retail) -> DataFrame:
    """Days from purchase to delivery, for delivered orders with a date."""
    arrived = F.col("order_delivered_customer_date")
    return r.orders.where(is_delivered() & arrived.isNotNull()).select(
        "order_id", dates.calendar_days(arrived, F.col("order_purchase_timestamp")).alias("delivery_days")
    )


def active_sellers(r: Retail) -> DataFrame:
    """Sellers with an item in a delivered order."""
    sold = _delivered_items(r).select("seller_id")
    return r.sellers.join(sold, "seller_id", "left_semi")


def anchor_date(r: Retail) -> DataFrame:
    """The date that counts as today: the latest purchase."""
    latest = F.max("order_purchase_timestamp").cast("date")
    return r.orders.agg(F.coalesce(latest, F.lit(FALLBACK_TODAY)).alias("today"))


def relative_window(r: Retail, period: str, recent_days: int = 30) -> DataFrame:
    """Orders of the last month, the last quarter or the recent days before today."""
    today = anchor_date(r).scalar()
    day = F.col("order_purchase_timestamp").cast("date")
    if period == "recent":
        return r.orders.where((day > F.date_sub(today, recent_days)) & (day <= today))
    unit, months = {"last_month": ("month", 1), "last_quarter": ("quarter", 3)}[period]
    end = F.trunc(today, unit)
    return r.orders.where((day >= F.add_months(end, -months)) & (day < end))


def top_categories_revenue(r: Retail, n: int = 5) -> DataFrame:
    """The best-selling English categories; ties by name."""
    return (
        english_items(r, _delivered_items(r).select("product_id", "price"))
        .groupBy(KEY)
        .agg(numbers.money_sum(F.col("price")).alias("revenue"))
        .orderBy(F.desc("revenue"), KEY)
        .limit(n)
    )


def revenue_share_by_city(r: Retail, n: int = 10) -> DataFrame:
    """The cities with most revenue and their share of all revenue, in percent."""
    by_order = _delivered_items(r, "customer_id").groupBy("customer_id").agg(F.sum("price").alias("price"))
    by_city = (
        by_order.join(r.customers.select("customer_id", "customer_city"), "customer_id")
        .groupBy("customer_city")
        .agg(numbers.money_sum(F.col("price")).alias("revenue"))
    )
    total = by_city.agg(numbers.money_sum(F.col("revenue"))).scalar()
    return (
        by_city.orderBy(F.desc("revenue"), "customer_city")
        .limit(n)
        .withColumn("share_pct", F.try_divide(F.col("revenue") * 100, total))
    )


def order_baskets(r: Retail) -> DataFrame:
    """Delivered orders: customer, time, items and value, one row per order."""
    basket = r.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(order_value()).alias("value")
    )
    orders = r.orders.where(is_delivered()).select("order_id", "customer_id", "order_purchase_timestamp")
    who = r.customers.select("customer_id", "customer_unique_id")
    return orders.join(basket, "order_id").join(who, "customer_id")


def repeat_rate_basket(r: Retail) -> DataFrame:
    """Per month: share of buyers who bought before or again, and items per order."""
    month = F.trunc("order_purchase_timestamp", "month")
    per_customer = (
        order_baskets(r)
        .groupBy("customer_unique_id", month.alias("month"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n_items").alias("n_items"))
    )
    earlier = Window.partitionBy("customer_unique_id").orderBy("month")
    repeat = (F.col("n_orders") > 1) | (F.row_number().over(earlier) > 1)
    return (
        per_customer.withColumn("repeat", repeat)
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("buyers"),
            numbers.safe_ratio(F.count_if("repeat"), F.count(F.lit(1))).alias("repeat_rate"),
            numbers.safe_ratio(F.sum("n_items"), F.sum("n_orders")).alias("avg_basket_size"),
        )
    )


def customer_lifetime_spend(r: Retail) -> DataFrame:
    """Value of all delivered orders per customer."""
    return order_baskets(r).groupBy("customer_unique_id").agg(
        numbers.money_sum(F.col("value")).alias("lifetime_spend")
    )


def aov_by_tier(r: Retail, profiles: DataFrame) -> DataFrame:
    """Average order value and lifetime value per risk tier."""
    per_customer = order_baskets(r).groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("value").alias("value")
    )
    tiers = profiles.select("customer_unique_id", "risk_profile")
    return (
        per_customer.join(tiers, "customer_unique_id")
        .groupBy("risk_profile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            numbers.safe_ratio(numbers.money_sum(F.col("value")), F.sum("n_orders")).alias("avg_order_value"),
            numbers.money_avg(F.col("value")).alias("avg_lifetime_value"),
        )
    )


def declining_categories(daily: DataFrame, periods: int = 3) -> DataFrame:
    """Categories whose monthly revenue fell in each of the last ``periods`` months or more.

    Months run from a category's first sale to the month of the latest sale of
    all; months without sales have a revenue of 0.
    """
    monthly = daily.groupBy(KEY, F.trunc("sale_date", "month").alias("month")).agg(
        numbers.money_sum(F.col("daily_revenue")).alias("revenue")
    )
    latest = monthly.agg(F.max("month")).scalar()
    spine = monthly.groupBy(KEY).agg(F.min("month").alias("start")).select(
        KEY, F.explode(F.sequence("start", latest, F.expr("interval 1 month"))).alias("month"))
    monthly = spine.join(monthly, [KEY, "month"], "left").na.fill({"revenue": 0.0})
    order = Window.partitionBy(KEY).orderBy("month")
    fell = F.coalesce(F.col("revenue") < F.lag("revenue").over(order), F.lit(False))
    steady = monthly.withColumn("fell", fell).withColumn(
        "last_steady", F.max(F.when(~F.col("fell"), F.col("month"))).over(Window.partitionBy(KEY))
    )
    return (
        steady.groupBy(KEY)
        .agg(
            F.count_if(F.col("month") > F.col("last_steady")).alias("falling_months"),
            F.max_by("revenue", "month").alias("last_revenue"),
        )
        .where(F.col("falling_months") >= periods)
    )


def _moments(n, total, squares):
    """Mean and sample deviation from a count and exact decimal sums; NULL where there are too few values."""
    mean = F.try_divide(total.cast("double"), n)
    left = squares.cast("double") - total.cast("double") * mean
    return mean, F.sqrt(F.greatest(F.try_divide(left, n - 1), F.lit(0.0)))


def seasonal_anomaly(r: Retail, threshold: float = 1.5) -> DataFrame:
    """Seller months far from the same calendar month of the seller's other years (two of them at least)."""
    sold = _delivered_items(r, "order_purchase_timestamp")
    bought = F.col("order_purchase_timestamp")
    monthly = sold.groupBy("seller_id", F.year(bought).alias("year"), F.month(bought).alias("month")).agg(
        numbers.money_sum(F.col("price")).alias("revenue")
    )
    same_month = Window.partitionBy("seller_id", "month")
    own = F.col("revenue").cast("decimal(18,4)")
    others = F.count(F.lit(1)).over(same_month) - 1
    mean, spread = _moments(
        others, F.sum(own).over(same_month) - own, F.sum(own * own).over(same_month) - own * own)
    z = F.when(others > 1, F.try_divide(F.col("revenue") - mean, spread))
    return monthly.withColumn("z_score", F.round(z, 4)).where(F.abs("z_score") >= threshold)


def customer_deviation(r: Retail, sigmas: float = 1.5) -> DataFrame:
    """Customers whose last basket lies outside the mean ± ``sigmas`` deviations of their earlier ones (two at least)."""
    last = F.struct("order_purchase_timestamp", "order_id")
    value = F.col("value").cast("decimal(18,4)")
    summed = order_baskets(r).groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max_by(value, last).alias("newest"),
        F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    newest = F.col("newest")
    mean, spread = _moments(F.col("n_orders") - 1, F.col("total") - newest, F.col("squares") - newest * newest)
    return summed.where(F.col("n_orders") > 2).select(
        "customer_unique_id", "n_orders", newest.cast("double").alias("last_basket"),
        mean.alias("mean_basket"), F.round(spread, 4).alias("sd_basket"),
    ).where(F.abs(F.col("last_basket") - F.col("mean_basket")) > sigmas * F.col("sd_basket"))
