"""Weekly demand per category and the features for its forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.binding import Retail
from mercato.functions import dates, numbers
from mercato.operators import series
from mercato.plans.delivery import is_delivered

KEY, WEEK = "category", "week_ending_date"
LAGS = {"weekly_revenue": "lag_1_revenue", "weekly_units": "lag_1_units"}
AVERAGES = {"weekly_revenue": "ewma_4_revenue", "weekly_units": "ewma_4_units"}


def english_items(r: Retail, items: DataFrame | None = None) -> DataFrame:
    """Items with the English category; items without a translation drop out."""
    names = r.products.select("product_id", "product_category_name").join(r.translation, "product_category_name")
    return (r.order_items if items is None else items).join(
        names.select("product_id", F.col("product_category_name_english").alias(KEY)), "product_id"
    )


def daily_category_sales(r: Retail) -> DataFrame:
    """Units and revenue per day and category, delivered orders only."""
    sold_on = r.orders.where(is_delivered()).select(
        "order_id", F.to_date("order_purchase_timestamp").alias("sale_date")
    )
    sold = r.order_items.select("order_id", "product_id", "order_item_id", "price").join(sold_on, "order_id")
    return (
        english_items(r, sold)
        .groupBy("sale_date", KEY)
        .agg(
            F.count("order_item_id").alias("units_sold"),
            numbers.money_sum(F.col("price")).alias("daily_revenue"),
        )
    )


def weekly_sales(daily: DataFrame) -> DataFrame:
    sums = {
        "weekly_revenue": numbers.money_sum(F.col("daily_revenue")),
        "weekly_units": F.sum("units_sold"),
    }
    return series.weekly_resample(daily, KEY, "sale_date", sums, WEEK)


def calendar_features(weekly: DataFrame) -> DataFrame:
    return weekly.withColumns({
        "year": dates.iso_year(F.col(WEEK)),
        "week_of_year": dates.iso_week(F.col(WEEK)),
    })


def lag_features(weekly: DataFrame) -> DataFrame:
    return series.lag_features(weekly, KEY, WEEK, LAGS)


def ewma_state(weekly: DataFrame) -> DataFrame:
    return series.ewma_state(weekly, KEY, WEEK, AVERAGES)


def ewma_features(weekly: DataFrame) -> DataFrame:
    """The averages as known the week before."""
    state = {out: f"_state_{out}" for out in AVERAGES.values()}
    averaged = series.ewma_state(weekly, KEY, WEEK, {c: state[out] for c, out in AVERAGES.items()})
    return series.lag_features(averaged, KEY, WEEK, {s: out for out, s in state.items()}).drop(*state.values())


def weekly_features(daily: DataFrame) -> DataFrame:
    """Training rows; the first week of each category has no past and drops out."""
    return calendar_features(ewma_features(lag_features(weekly_sales(daily)))).dropna()


def next_week_features(daily: DataFrame) -> DataFrame:
    """One row per category for the week after its last one."""
    state = series.latest_state(ewma_state(weekly_sales(daily)), KEY, WEEK)
    target = F.date_add(WEEK, 7)
    return state.select(
        KEY,
        target.alias("target_date"),
        dates.iso_year(target).alias("year"),
        dates.iso_week(target).alias("week_of_year"),
        F.col("weekly_revenue").alias("lag_1_revenue"),
        F.col("weekly_units").alias("lag_1_units"),
        "ewma_4_revenue",
        "ewma_4_units",
    )


def top_categories(df: DataFrame, value: str, n: int = 5, out: str = "total") -> DataFrame:
    """The ``n`` categories with the largest sum; ties by name."""
    totals = df.groupBy(KEY).agg(numbers.money_sum(F.col(value)).alias(out))
    return totals.orderBy(F.desc(out), KEY).limit(n)
