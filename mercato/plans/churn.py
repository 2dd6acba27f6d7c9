"""Customer profiles for churn: recency, frequency, spend and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.binding import Retail
from mercato.functions import dates, numbers, text
from mercato.plans.delivery import is_delivered

FEATURES = ["recency_days", "total_orders", "total_spent", "avg_review_score"]

# The names of the three customer groups.
HIGH_RISK = "High Risk (Churned / Unhappy)"
MEDIUM_RISK = "Medium Risk (Promising / Needs Nurturing)"
LOW_RISK = "Low Risk (Loyal VIPs)"


def customer_orders_items(r: Retail) -> DataFrame:
    """Items of delivered orders with the customer who bought them."""
    bought = r.orders.where(is_delivered()).select("order_id", "customer_id", "order_purchase_timestamp")
    who = r.customers.select("customer_id", "customer_unique_id")
    return r.order_items.join(bought.join(who, "customer_id"), "order_id")


def order_reviews(r: Retail) -> DataFrame:
    """Delivered orders with the sums of their items and, where there are any, reviews.

    One row per order. A join of items with reviews has ``n_items`` times
    ``n_reviews`` rows for an order; every sum over that join is a product of
    the sums here, so it need not be made.
    """
    spend = r.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum((F.col("price") + F.col("freight_value")).cast("decimal(18,4)")).alias("spent"),
    )
    reviews = r.order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("review_score").alias("n_scores"),
        F.sum("review_score").alias("score_sum"),
    )
    orders = r.orders.where(is_delivered()).select("order_id", "customer_id", "order_purchase_timestamp")
    return orders.join(spend, "order_id").join(reviews, "order_id", "left")


def churn_profile(r: Retail, repeat_items_per_review: bool = True) -> DataFrame:
    """Last purchase, orders, spend and mean review score per customer.

    The training data joins items with reviews, so an order's spend counts once
    per review and a review counts once per item. Both effects are products of
    per-order counts, hence items and reviews are summed per order first and
    the rows never multiply. ``repeat_items_per_review=False`` counts every
    item and every review once.
    """
    orders = order_reviews(r)
    if repeat_items_per_review:
        spend_times = F.greatest(F.coalesce("n_reviews", F.lit(1)), F.lit(1))
        review_times = F.col("n_items")
    else:
        spend_times, review_times = F.lit(1), F.lit(1)
    sums = orders.join(r.customers.select("customer_id", "customer_unique_id"), "customer_id")
    return (
        sums.groupBy("customer_unique_id")
        .agg(
            F.max("order_purchase_timestamp").alias("last_purchase_date"),
            F.count(F.lit(1)).alias("total_orders"),
            numbers.money_sum(F.col("spent") * spend_times).alias("total_spent"),
            numbers.safe_ratio(
                F.sum(F.col("score_sum") * review_times), F.sum(F.col("n_scores") * review_times)
            ).alias("avg_review_score"),
        )
    )


def rfm_recency(profile: DataFrame) -> DataFrame:
    """Whole days since the last purchase, seen from the latest purchase of all."""
    today = profile.agg(F.max("last_purchase_date")).scalar()
    return profile.withColumn(
        "recency_days", dates.elapsed_days(today, F.col("last_purchase_date")).cast("bigint")
    )


def cluster_summary(profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean of the four features per cluster, rounded to 2 digits."""
    return profiles.groupBy(cluster).agg(
        *[F.round(numbers.money_avg(F.col(c)), 2).alias(c) for c in FEATURES]
    )


def cluster_risk_map(summary: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Name each cluster.

    The lowest mean review score is high risk, the highest spend of the others
    is the loyal group, what is left is in between. Ties go to the lower id.
    """
    unhappy = summary.agg(F.min_by(cluster, F.struct("avg_review_score", cluster))).scalar()
    others = summary.where(F.col(cluster) != unhappy)
    loyal = others.agg(F.min_by(cluster, F.struct(-F.col("total_spent"), cluster))).scalar()
    return summary.select(
        cluster,
        F.when(F.col(cluster) == unhappy, HIGH_RISK)
        .when(F.col(cluster) == loyal, LOW_RISK)
        .otherwise(MEDIUM_RISK)
        .alias("risk_profile"),
    )


def map_labels(profiles: DataFrame, names: DataFrame, cluster: str = "cluster") -> DataFrame:
    return profiles.join(names, cluster, "left")


def lookup_profile(asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """Risk profile of each asked customer id; ids may carry blanks around them."""
    clean = asked.select(text.strip(F.col("customer_unique_id")).alias("customer_unique_id"))
    known = profiles.select("customer_unique_id", "risk_profile")
    found = F.col("risk_profile").isNotNull()
    missing = F.concat(F.lit("Customer ID '"), "customer_unique_id", F.lit("' not found in the database."))
    return clean.join(known, "customer_unique_id", "left").select(
        "customer_unique_id",
        F.when(found, "success").otherwise("error").alias("status"),
        F.when(found, "Churn Risk Profile").alias("metric"),
        F.col("risk_profile").alias("value"),
        F.when(~found, missing).alias("message"),
    )
