"""Queries over filters, joins and the three feature marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.binding import bind
from mercato.functions import numbers
from mercato.operators import series
from mercato.plans import churn, delivery, demand, metrics, refresh
from mercato.registry.base import query
from mercato.session import scratch_path
from mercato.sources.files import materialize


@query("filter_delivered", "SELECT order_id, order_delivered_customer_date, order_estimated_delivery_date FROM dated_orders")
def filter_delivered(spark, d):
    return delivery.filter_delivered(bind(spark, d).orders).select(
        "order_id", "order_delivered_customer_date", "order_estimated_delivery_date"
    )


@query("flag_delayed", """
SELECT order_id, CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END AS is_delayed
FROM r_orders
""")
def flag_delayed(spark, d):
    return bind(spark, d).orders.select("order_id", delivery.delayed_flag().alias("is_delayed"))


@query("flag_interstate", """
SELECT o.order_id, order_item_id, i.product_id, i.seller_id, CASE WHEN customer_state <> seller_state THEN 1 ELSE 0 END AS is_interstate
FROM r_items i JOIN r_orders o ON i.order_id = o.order_id JOIN r_customers c ON o.customer_id = c.customer_id
JOIN r_sellers s ON i.seller_id = s.seller_id
""")
def flag_interstate(spark, d):
    r = bind(spark, d)
    return (
        r.order_items.join(r.orders.select("order_id", "customer_id"), "order_id")
        .join(r.customers, "customer_id")
        .join(r.sellers, "seller_id")
        .select("order_id", "order_item_id", "product_id", "seller_id", delivery.interstate_flag().alias("is_interstate"))
    )


@query("order_lookup", """
SELECT a.order_id, l.order_id IS NOT NULL AS found, purchase_month, purchase_day_of_week, estimated_days_to_deliver,
       total_freight_value, total_weight_g, total_volume_cm3, is_interstate, seller_historical_delay_rate
FROM (SELECT DISTINCT event_id AS order_id FROM events) a
LEFT JOIN (SELECT * FROM live_features QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seller_state) = 1) l
  ON a.order_id = l.order_id
""")
def order_lookup(spark, d):
    """Every event id is asked for as an order id; ids without items are not found."""
    asked = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("order_id"))
    return delivery.serving_features(bind(spark, d), asked)


@query("join_star_delivery", """
SELECT o.order_id, order_item_id, i.product_id, i.seller_id, customer_state, seller_state, product_weight_g
FROM dated_orders o JOIN r_customers c ON o.customer_id = c.customer_id JOIN r_items i ON o.order_id = i.order_id
JOIN r_products p ON i.product_id = p.product_id JOIN r_sellers s ON i.seller_id = s.seller_id
""")
def join_star_delivery(spark, d):
    r = bind(spark, d)
    return (
        r.order_items.join(delivery.filter_delivered(r.orders).select("order_id", "customer_id"), "order_id")
        .join(r.customers, "customer_id")
        .join(r.products, "product_id")
        .join(r.sellers, "seller_id")
        .select("order_id", "order_item_id", "product_id", "seller_id", "customer_state", "seller_state", "product_weight_g")
    )


@query("join_left_delay_rate", """
SELECT s.seller_id, seller_state, delayed_orders / nullif(total_orders, 0) AS delay_rate
FROM r_sellers s LEFT JOIN seller_stats d ON s.seller_id = d.seller_id
""")
def join_left_delay_rate(spark, d):
    r = bind(spark, d)
    rates = delivery.seller_delay_rates(delivery.seller_delay_stats(r.orders, r.order_items))
    return r.sellers.select("seller_id", "seller_state").join(rates, "seller_id", "left")


@query("join_customer_orders_items", """
SELECT customer_unique_id, o.order_id, order_item_id, product_id, CAST(price AS DOUBLE) AS price
FROM r_customers c JOIN r_orders o ON c.customer_id = o.customer_id JOIN r_items i ON o.order_id = i.order_id
WHERE order_status = 'delivered'
""")
def join_customer_orders_items(spark, d):
    return churn.customer_orders_items(bind(spark, d)).select(
        "customer_unique_id", "order_id", "order_item_id", "product_id", F.col("price").cast("double").alias("price")
    )


@query("join_left_reviews", """
SELECT o.order_id, count(*) AS joined_rows, count(review_id) AS rows_with_review,
       CAST(sum(CAST(price + freight_value AS DECIMAL(18,4))) AS DOUBLE) AS joined_spend,
       CAST(sum(review_score) AS BIGINT) AS joined_score
FROM r_orders o JOIN r_items i ON o.order_id = i.order_id LEFT JOIN r_reviews v ON o.order_id = v.order_id
WHERE order_status = 'delivered' GROUP BY o.order_id
""")
def join_left_reviews(spark, d):
    """What the join of items and reviews gives per order, from one row per order and side."""
    n_items, n_reviews = F.col("n_items"), F.coalesce("n_reviews", F.lit(0))
    return churn.order_reviews(bind(spark, d)).select(
        "order_id",
        (n_items * F.greatest(n_reviews, F.lit(1))).alias("joined_rows"),
        (n_items * n_reviews).alias("rows_with_review"),
        (F.col("spent") * F.greatest(n_reviews, F.lit(1))).cast("double").alias("joined_spend"),
        (F.col("score_sum") * n_items).alias("joined_score"),
    )


@query("join_translate", """
SELECT product_id, product_category_name_english AS category FROM r_products JOIN r_translation USING (product_category_name)
""")
def join_translate(spark, d):
    return metrics.english_category(bind(spark, d))


@query("semi_active_sellers", """
SELECT seller_id, seller_state FROM r_sellers
WHERE seller_id IN (SELECT seller_id FROM r_items JOIN r_orders USING (order_id) WHERE order_status = 'delivered')
""")
def semi_active_sellers(spark, d):
    return metrics.active_sellers(bind(spark, d)).select("seller_id", "seller_state")


@query("seller_delay_stats", "SELECT * FROM seller_stats")
def seller_delay_stats(spark, d):
    r = bind(spark, d)
    return delivery.seller_delay_stats(r.orders, r.order_items)


@query("seller_delay_stats_live", "SELECT * FROM live_seller_stats")
def seller_delay_stats_live(spark, d):
    r = bind(spark, d)
    return delivery.seller_delay_stats(r.orders, r.order_items, delivered_only=False)


@query("safe_ratio", """
SELECT seller_state, max(delayed_orders / nullif(total_orders, 0)) AS max_delay_rate,
       max(delayed_orders / nullif(delayed_orders - delayed_orders, 0)) AS nothing
FROM seller_stats JOIN r_sellers USING (seller_id) GROUP BY seller_state
""")
def safe_ratio(spark, d):
    r = bind(spark, d)
    stats = delivery.seller_delay_stats(r.orders, r.order_items)
    late, total = F.col("delayed_orders"), F.col("total_orders")
    return stats.join(r.sellers, "seller_id").groupBy("seller_state").agg(
        F.max(numbers.safe_ratio(late, total)).alias("max_delay_rate"),
        F.max(numbers.safe_ratio(late, late - late)).alias("nothing"),
    )


@query("delivery_features", "SELECT * FROM features")
def delivery_features(spark, d):
    return delivery.delivery_features(bind(spark, d))


@query("delivery_features_point_in_time", """
WITH lines AS (
  SELECT o.order_id, o.order_purchase_timestamp, o.order_estimated_delivery_date, o.is_delayed, customer_state, seller_state,
         i.seller_id, freight_value, product_weight_g, product_length_cm * product_height_cm * product_width_cm AS volume
  FROM dated_orders o JOIN r_customers c ON o.customer_id = c.customer_id JOIN r_items i ON o.order_id = i.order_id
  JOIN r_products p ON i.product_id = p.product_id JOIN r_sellers s ON i.seller_id = s.seller_id),
per_day AS (
  SELECT seller_id, CAST(order_delivered_customer_date AS DATE) AS day, count(*) AS n, sum(is_delayed) AS late
  FROM dated_orders o JOIN r_items i ON o.order_id = i.order_id GROUP BY 1, 2),
asked AS (SELECT DISTINCT seller_id, CAST(order_purchase_timestamp AS DATE) AS day FROM lines),
rates AS (
  SELECT a.seller_id, a.day, CAST(sum(late) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS delay_rate
  FROM asked a LEFT JOIN per_day d ON a.seller_id = d.seller_id AND d.day < a.day GROUP BY 1, 2)
SELECT order_id, CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
       CAST(dayofweek(order_purchase_timestamp) + 1 AS INTEGER) AS purchase_day_of_week,
       CAST(date_diff('day', order_purchase_timestamp, order_estimated_delivery_date) AS INTEGER) AS estimated_days_to_deliver,
       is_delayed, CAST(sum(freight_value) AS DOUBLE) AS total_freight_value, sum(product_weight_g) AS total_weight_g,
       sum(volume) AS total_volume_cm3, CASE WHEN customer_state <> seller_state THEN 1 ELSE 0 END AS is_interstate,
       max(delay_rate) AS seller_historical_delay_rate
FROM lines JOIN rates ON lines.seller_id = rates.seller_id AND day = CAST(order_purchase_timestamp AS DATE)
GROUP BY order_id, order_purchase_timestamp, order_estimated_delivery_date, is_delayed, customer_state, seller_state
""")
def delivery_features_point_in_time(spark, d):
    return delivery.delivery_features(bind(spark, d), point_in_time=True)


@query("baseline_delay_rate", "SELECT avg(is_delayed) * 100 AS baseline_delay_rate FROM features")
def baseline_delay_rate(spark, d):
    return delivery.baseline_delay_rate(delivery.delivery_features(bind(spark, d)))


@query("churn_profile", "SELECT * FROM churn")
def churn_profile(spark, d):
    return churn.churn_profile(bind(spark, d))


@query("order_output", "SELECT * FROM churn ORDER BY total_orders DESC, customer_unique_id")
def order_output(spark, d):
    return churn.churn_profile(bind(spark, d)).orderBy(F.desc("total_orders"), "customer_unique_id")


@query("daily_category_sales", "SELECT * FROM daily")
def daily_category_sales(spark, d):
    return demand.daily_category_sales(bind(spark, d, fine_categories=True))


@query("refresh_daily_sales", "SELECT * FROM daily")
def refresh_daily_sales(spark, d):
    """The daily mart built without some orders and with others in an earlier state, then refreshed from the changes."""
    r = bind(spark, d, fine_categories=True)
    names = r.products.select("product_id", "product_category_name").join(r.translation, "product_category_name").select(
        "product_id", F.col("product_category_name_english").alias(demand.KEY))
    part = F.pmod(F.xxhash64("order_id"), F.lit(10))
    known = r.orders.where(part != 0).withColumn("order_status", F.when(part == 1, "shipped").otherwise(F.col("order_status")))
    mart = refresh.DailyMart(spark, scratch_path(spark, "daily-mart")).build(known, r.order_items, names)
    mart.refresh(r.orders.where(part <= 1), r.order_items, names)
    return mart.daily.drop(refresh.MONTH)


@query("rfm_recency", "SELECT customer_unique_id, last_purchase_date, recency_days FROM recency")
def rfm_recency(spark, d):
    return churn.rfm_recency(churn.churn_profile(bind(spark, d))).select(
        "customer_unique_id", "last_purchase_date", "recency_days"
    )


@query("cross_scalar", """
SELECT order_id, date_diff('day', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM r_orders)) AS age_days
FROM r_orders
""")
def cross_scalar(spark, d):
    orders = bind(spark, d).orders
    latest = orders.agg(F.max("order_purchase_timestamp")).scalar()
    bought = F.col("order_purchase_timestamp")
    return orders.select("order_id", F.extract(F.lit("DAY"), latest - bought).cast("bigint").alias("age_days"))


def clustered(spark, d):
    """Profiles with a rule in place of k-means, so that SQL can follow.

    Written once: the reports on the groups read them several times.
    """
    rule = F.when(F.col("avg_review_score") < 2, 0).when(F.col("total_orders") > 3, 1).otherwise(2)
    profile = materialize(churn.churn_profile(bind(spark, d)), "churn")
    return churn.rfm_recency(profile).withColumn("cluster", rule)


def profiles(spark, d):
    rows = clustered(spark, d)
    return churn.map_labels(rows, churn.cluster_risk_map(churn.cluster_summary(rows)))


@query("cluster_summary", "SELECT * FROM summary")
def cluster_summary(spark, d):
    return churn.cluster_summary(clustered(spark, d))


@query("cluster_risk_map", "SELECT * FROM risk_names")
def cluster_risk_map(spark, d):
    return churn.cluster_risk_map(churn.cluster_summary(clustered(spark, d)))


@query("map_labels", "SELECT customer_unique_id, cluster, risk_profile FROM profiles")
def map_labels(spark, d):
    return profiles(spark, d).select("customer_unique_id", "cluster", "risk_profile")


@query("lookup_profile", """
SELECT c_name AS customer_unique_id, CASE WHEN risk_profile IS NULL THEN 'error' ELSE 'success' END AS status,
       CASE WHEN risk_profile IS NOT NULL THEN 'Churn Risk Profile' END AS metric, risk_profile AS value,
       CASE WHEN risk_profile IS NULL THEN 'Customer ID ''' || c_name || ''' not found in the database.' END AS message
FROM customer LEFT JOIN profiles ON c_name = customer_unique_id
""")
def lookup_profile(spark, d):
    """Every customer is asked for, with blanks around the id."""
    padded = F.concat(F.lit(" \n"), F.col("c_name"), F.lit("\t "))
    asked = spark.read.parquet(f"{d}/customer.parquet").select(padded.alias("customer_unique_id"))
    return churn.lookup_profile(asked, profiles(spark, d))


@query("weekly_resample", "SELECT * FROM weekly")
def weekly_resample(spark, d):
    return demand.weekly_sales(daily_category_sales(spark, d))


@query("lag_features", """
SELECT category, week_ending_date, weekly_revenue, weekly_units, lag_1_revenue, lag_1_units FROM weekly_feat
""")
def lag_features(spark, d):
    return demand.lag_features(weekly_resample(spark, d))


@query("ewma_state", "SELECT * FROM weekly_state")
def ewma_state(spark, d):
    return demand.ewma_state(weekly_resample(spark, d))


@query("ewma_features", """
SELECT category, week_ending_date, weekly_revenue, weekly_units, ewma_4_revenue, ewma_4_units FROM weekly_feat
""")
def ewma_features(spark, d):
    return demand.ewma_features(weekly_resample(spark, d))


@query("latest_state", """
SELECT * FROM weekly_state QUALIFY row_number() OVER (PARTITION BY category ORDER BY week_ending_date DESC) = 1
""")
def latest_state(spark, d):
    return series.latest_state(ewma_state(spark, d), demand.KEY, demand.WEEK)


@query("drop_incomplete", "SELECT * FROM train_rows")
def drop_incomplete(spark, d):
    return demand.weekly_features(daily_category_sales(spark, d))


@query("time_cutoff_split", """
SELECT category, week_ending_date, CASE WHEN t.week_ending_date IN (SELECT week_ending_date FROM test_rows) THEN 'test' ELSE 'train' END AS part
FROM train_rows t
""")
def time_cutoff_split(spark, d):
    train, test = series.time_cutoff_split(drop_incomplete(spark, d), demand.WEEK)
    columns = ["category", "week_ending_date"]
    return train.select(*columns, F.lit("train").alias("part")).unionByName(
        test.select(*columns, F.lit("test").alias("part"))
    )


@query("topk_categories", """
SELECT category, CAST(sum(CAST(weekly_revenue AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM test_rows GROUP BY category ORDER BY total DESC, category LIMIT 5
""")
def topk_categories(spark, d):
    _, test = series.time_cutoff_split(drop_incomplete(spark, d), demand.WEEK)
    return demand.top_categories(test, "weekly_revenue")


@query("forecast_features", """
SELECT category, week_ending_date + 7 AS target_date, CAST(isoyear(week_ending_date + 7) AS INTEGER) AS year,
       CAST(week(week_ending_date + 7) AS INTEGER) AS week_of_year, weekly_revenue AS lag_1_revenue,
       weekly_units AS lag_1_units, ewma_4_revenue, ewma_4_units
FROM weekly_state QUALIFY row_number() OVER (PARTITION BY category ORDER BY week_ending_date DESC) = 1
""")
def forecast_features(spark, d):
    return demand.next_week_features(daily_category_sales(spark, d))


@query("global_stats", """
SELECT max(weekly_units) AS max_value, CAST(sum(weekly_units) AS DOUBLE) / count(weekly_units) AS mean_value FROM train_rows
""")
def global_stats(spark, d):
    from mercato.ml.evaluate import global_stats as stats

    return stats(drop_incomplete(spark, d), "weekly_units")
