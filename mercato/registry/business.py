"""Queries over the business metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.binding import bind
from mercato.plans import demand, metrics
from mercato.registry.base import part, query
from mercato.registry.marts import profiles

part("delivered_items", """
SELECT i.*, customer_id, order_purchase_timestamp FROM r_items i JOIN r_orders o ON i.order_id = o.order_id
WHERE order_status = 'delivered'
""")


@query("revenue", "SELECT CAST(sum(price) AS DOUBLE) AS revenue FROM delivered_items")
def revenue(spark, d):
    return metrics.revenue(bind(spark, d))


@query("total_order_value", "SELECT CAST(sum(price + freight_value) AS DOUBLE) AS total_order_value FROM r_items")
def total_order_value(spark, d):
    return metrics.total_order_value(bind(spark, d))


@query("english_category", """
SELECT product_category_name_english AS category, count(*) AS n_items, CAST(sum(price) AS DOUBLE) AS item_value
FROM r_items JOIN r_products USING (product_id) JOIN r_translation USING (product_category_name) GROUP BY 1
""")
def english_category(spark, d):
    return demand.english_items(bind(spark, d)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("price").cast("double").alias("item_value")
    )


@query("delivery_time_days", """
SELECT order_id, CAST(date_diff('day', order_purchase_timestamp, order_delivered_customer_date) AS INTEGER) AS delivery_days
FROM r_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
""")
def delivery_time_days(spark, d):
    return metrics.delivery_time_days(bind(spark, d))


@query("active_sellers", "SELECT count(DISTINCT seller_id) AS active_sellers FROM delivered_items JOIN r_sellers USING (seller_id)")
def active_sellers(spark, d):
    return metrics.active_sellers(bind(spark, d)).agg(F.count(F.lit(1)).alias("active_sellers"))


@query("anchor_date", "SELECT CAST(max(order_purchase_timestamp) AS DATE) AS today FROM r_orders")
def anchor_date(spark, d):
    return metrics.anchor_date(bind(spark, d))


@query("relative_window", """
SELECT period, count(*) AS n_orders, min(order_purchase_timestamp) AS first_order, max(order_purchase_timestamp) AS last_order
FROM r_orders, (SELECT CAST(max(order_purchase_timestamp) AS DATE) AS today FROM r_orders) t,
     (VALUES ('last_month'), ('last_quarter'), ('recent')) p(period)
WHERE CASE period
  WHEN 'last_month' THEN order_purchase_timestamp >= date_trunc('month', today) - INTERVAL 1 MONTH
                     AND order_purchase_timestamp < date_trunc('month', today)
  WHEN 'last_quarter' THEN order_purchase_timestamp >= date_trunc('quarter', today) - INTERVAL 3 MONTH
                       AND order_purchase_timestamp < date_trunc('quarter', today)
  ELSE CAST(order_purchase_timestamp AS DATE) > today - 30 END
GROUP BY period
""")
def relative_window(spark, d):
    r = bind(spark, d)
    bought = "order_purchase_timestamp"
    parts = [
        metrics.relative_window(r, period).groupBy(F.lit(period).alias("period")).agg(
            F.count(F.lit(1)).alias("n_orders"), F.min(bought).alias("first_order"), F.max(bought).alias("last_order")
        )
        for period in ("last_month", "last_quarter", "recent")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_categories_revenue", """
SELECT product_category_name_english AS category, CAST(sum(price) AS DOUBLE) AS revenue
FROM delivered_items JOIN r_products USING (product_id) JOIN r_translation USING (product_category_name)
GROUP BY 1 ORDER BY revenue DESC, category LIMIT 5
""")
def top_categories_revenue(spark, d):
    return metrics.top_categories_revenue(bind(spark, d))


@query("revenue_share_by_city", """
SELECT customer_city, CAST(sum(price) AS DOUBLE) AS revenue,
       CAST(sum(price) AS DOUBLE) * 100 / (SELECT CAST(sum(price) AS DOUBLE) FROM delivered_items) AS share_pct
FROM delivered_items JOIN r_customers USING (customer_id) GROUP BY customer_city
ORDER BY revenue DESC, customer_city LIMIT 10
""")
def revenue_share_by_city(spark, d):
    return metrics.revenue_share_by_city(bind(spark, d))


@query("repeat_rate_basket", """
WITH per_customer AS (
  SELECT customer_unique_id, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month,
         count(*) AS n_orders, sum(n_items) AS n_items
  FROM baskets GROUP BY 1, 2)
SELECT p.month, count(*) AS buyers,
       CAST(count(*) FILTER (n_orders > 1 OR p.month > first_month) AS DOUBLE) / count(*) AS repeat_rate,
       CAST(sum(n_items) AS DOUBLE) / CAST(sum(n_orders) AS DOUBLE) AS avg_basket_size
FROM per_customer p JOIN (SELECT customer_unique_id, min(month) AS first_month FROM per_customer GROUP BY 1) f
  USING (customer_unique_id)
GROUP BY p.month
""")
def repeat_rate_basket(spark, d):
    return metrics.repeat_rate_basket(bind(spark, d))


@query("customer_lifetime_spend", """
SELECT customer_unique_id, CAST(sum(value) AS DOUBLE) AS lifetime_spend FROM baskets GROUP BY 1
""")
def customer_lifetime_spend(spark, d):
    return metrics.customer_lifetime_spend(bind(spark, d))


@query("aov_by_tier", """
SELECT risk_profile, count(*) AS customers, CAST(sum(value) AS DOUBLE) / CAST(sum(n_orders) AS DOUBLE) AS avg_order_value,
       CAST(sum(value) AS DOUBLE) / count(value) AS avg_lifetime_value
FROM (SELECT customer_unique_id, count(*) AS n_orders, sum(value) AS value FROM baskets GROUP BY 1)
JOIN profiles USING (customer_unique_id) GROUP BY risk_profile
""")
def aov_by_tier(spark, d):
    return metrics.aov_by_tier(bind(spark, d), profiles(spark, d))


@query("declining_categories", """
WITH sold AS (
  SELECT category, CAST(date_trunc('month', sale_date) AS DATE) AS month,
         CAST(sum(CAST(daily_revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM daily GROUP BY 1, 2),
months AS (
  SELECT category, CAST(unnest(generate_series(min(month), (SELECT max(month) FROM sold), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM sold GROUP BY category),
monthly AS (SELECT category, month, coalesce(revenue, 0) AS revenue FROM months LEFT JOIN sold USING (category, month)),
moves AS (SELECT *, coalesce(revenue < lag(revenue) OVER (PARTITION BY category ORDER BY month), false) AS fell FROM monthly),
steady AS (SELECT category, max(month) AS last_steady FROM moves WHERE NOT fell GROUP BY 1)
SELECT category, count(*) FILTER (month > last_steady) AS falling_months, arg_max(revenue, month) AS last_revenue
FROM moves JOIN steady USING (category) GROUP BY category HAVING count(*) FILTER (month > last_steady) >= 3
""")
def declining_categories(spark, d):
    return metrics.declining_categories(demand.daily_category_sales(bind(spark, d, fine_categories=True)))


@query("seasonal_anomaly", """
WITH monthly AS (
  SELECT seller_id, CAST(year(order_purchase_timestamp) AS INTEGER) AS year,
         CAST(month(order_purchase_timestamp) AS INTEGER) AS month, CAST(sum(price) AS DOUBLE) AS revenue
  FROM delivered_items GROUP BY ALL),
sums AS (
  SELECT *, count(*) OVER w - 1 AS others, CAST(revenue AS DECIMAL(19,4)) AS own,
         sum(CAST(revenue AS DECIMAL(18,4))) OVER w AS total,
         sum(CAST(revenue AS DECIMAL(19,4)) * CAST(revenue AS DECIMAL(19,4))) OVER w AS squares
  FROM monthly WINDOW w AS (PARTITION BY seller_id, month)),
moments AS (
  SELECT *, CAST(total - own AS DOUBLE) AS rest, CAST(squares - own * own AS DOUBLE) AS rest_squares FROM sums WHERE others > 1)
SELECT seller_id, year, month, revenue, z_score FROM (
  SELECT *, round((revenue - rest / others) / nullif(sqrt(greatest((rest_squares - rest * (rest / others)) / (others - 1), 0)), 0), 4) AS z_score
  FROM moments)
WHERE abs(z_score) >= 1.5
""")
def seasonal_anomaly(spark, d):
    return metrics.seasonal_anomaly(bind(spark, d))


@query("customer_deviation", """
WITH summed AS (
  SELECT customer_unique_id, count(*) AS n_orders, arg_max(CAST(value AS DECIMAL(19,4)), (order_purchase_timestamp, order_id)) AS newest,
         sum(CAST(value AS DECIMAL(18,4))) AS total, sum(CAST(value AS DECIMAL(19,4)) * CAST(value AS DECIMAL(19,4))) AS squares
  FROM baskets GROUP BY customer_unique_id),
rests AS (
  SELECT *, CAST(total - newest AS DOUBLE) AS rest, CAST(squares - newest * newest AS DOUBLE) AS rest_squares FROM summed WHERE n_orders > 2)
SELECT * FROM (
  SELECT customer_unique_id, n_orders, CAST(newest AS DOUBLE) AS last_basket, rest / (n_orders - 1) AS mean_basket,
         round(sqrt(greatest((rest_squares - rest * (rest / (n_orders - 1))) / (n_orders - 2), 0)), 4) AS sd_basket
  FROM rests)
WHERE abs(last_basket - mean_basket) > 1.5 * sd_basket
""")
def customer_deviation(spark, d):
    return metrics.customer_deviation(bind(spark, d))
