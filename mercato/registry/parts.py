"""The retail tables and feature sets in SQL, as parts for the oracle queries."""

from mercato.registry.base import part

part("r_shipped", """
SELECT l_orderkey AS order_id, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_orderkey
""")
part("r_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
       o_orderdate AS order_purchase_timestamp, o_orderdate AS order_approved_at,
       CASE WHEN o_orderstatus = 'F' THEN first_ship END AS order_delivered_carrier_date,
       CASE WHEN o_orderstatus = 'F' THEN last_ship END AS order_delivered_customer_date,
       o_orderdate + to_days(300 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS order_estimated_delivery_date
FROM orders LEFT JOIN r_shipped ON order_id = o_orderkey
""")
part("r_items", """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value
FROM lineitem
""")
part("r_products", """
SELECT p_partkey AS product_id, p_type AS product_category_name, CAST(length(p_name) AS INTEGER) AS product_name_lenght,
       p_size * 100.0::DOUBLE AS product_weight_g, p_size::DOUBLE AS product_length_cm,
       (p_size % 7 + 1)::DOUBLE AS product_height_cm, (p_size % 5 + 1)::DOUBLE AS product_width_cm
FROM part
""")
part("r_translation", """
SELECT DISTINCT p_type AS product_category_name, lower(p_type) || '_goods' AS product_category_name_english
FROM part WHERE p_type <> 'PROMO'
""")
part("r_fine_names", """
SELECT p_partkey AS product_id, lower(replace(p_type || '_' || p_brand, '#', '')) || '_goods' AS category
FROM part WHERE p_type <> 'PROMO'
""")
part("r_sellers", """
SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
       n_name AS seller_city, CAST(s_nationkey AS VARCHAR) AS seller_state
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
part("r_customers", """
SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
       n_name AS customer_city, CAST(c_nationkey AS VARCHAR) AS customer_state
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
part("r_payments", """
SELECT o_orderkey AS order_id, 1 AS payment_sequential, CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value FROM orders
""")
part("r_reviews", """
SELECT event_id AS review_id, event_id // 2 AS order_id,
       CAST(least(4, floor(value / 30)) AS INTEGER) + 1 AS review_score,
       CASE WHEN event_type <> 'click' THEN props END AS review_comment_title,
       CASE WHEN event_type <> 'error' THEN event_type END AS review_comment_message
FROM events
""")
part("dated_orders", """
SELECT *, CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END AS is_delayed
FROM r_orders
WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
  AND order_estimated_delivery_date IS NOT NULL
""")
part("seller_stats", """
SELECT seller_id, count(o.order_id) AS total_orders, CAST(sum(is_delayed) AS BIGINT) AS delayed_orders
FROM dated_orders o JOIN r_items i ON o.order_id = i.order_id GROUP BY seller_id
""")
part("live_seller_stats", """
SELECT seller_id, count(o.order_id) AS total_orders,
       CAST(sum(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END) AS BIGINT) AS delayed_orders
FROM r_orders o JOIN r_items i ON o.order_id = i.order_id GROUP BY seller_id
""")
part("features_by_state", """
SELECT o.order_id, CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
       CAST(dayofweek(order_purchase_timestamp) + 1 AS INTEGER) AS purchase_day_of_week,
       CAST(date_diff('day', order_purchase_timestamp, order_estimated_delivery_date) AS INTEGER) AS estimated_days_to_deliver,
       is_delayed, CAST(sum(freight_value) AS DOUBLE) AS total_freight_value,
       sum(product_weight_g) AS total_weight_g,
       sum(product_length_cm * product_height_cm * product_width_cm) AS total_volume_cm3,
       CASE WHEN customer_state <> seller_state THEN 1 ELSE 0 END AS is_interstate,
       max(delayed_orders / nullif(total_orders, 0)) AS seller_historical_delay_rate, seller_state
FROM dated_orders o
JOIN r_customers c ON o.customer_id = c.customer_id
JOIN r_items i ON o.order_id = i.order_id
JOIN r_products p ON i.product_id = p.product_id
JOIN r_sellers s ON i.seller_id = s.seller_id
LEFT JOIN seller_stats d ON s.seller_id = d.seller_id
GROUP BY o.order_id, order_purchase_timestamp, order_estimated_delivery_date, is_delayed, customer_state, seller_state
""")
part("features", "SELECT * EXCLUDE (seller_state) FROM features_by_state")
part("live_features", """
SELECT o.order_id, CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
       CAST(dayofweek(order_purchase_timestamp) + 1 AS INTEGER) AS purchase_day_of_week,
       CAST(date_diff('day', order_purchase_timestamp, order_estimated_delivery_date) AS INTEGER) AS estimated_days_to_deliver,
       CAST(sum(freight_value) AS DOUBLE) AS total_freight_value,
       sum(product_weight_g) AS total_weight_g,
       sum(product_length_cm * product_height_cm * product_width_cm) AS total_volume_cm3,
       CASE WHEN customer_state <> seller_state THEN 1 ELSE 0 END AS is_interstate,
       max(delayed_orders / nullif(total_orders, 0)) AS seller_historical_delay_rate, seller_state
FROM r_orders o
JOIN r_customers c ON o.customer_id = c.customer_id
JOIN r_items i ON o.order_id = i.order_id
JOIN r_products p ON i.product_id = p.product_id
JOIN r_sellers s ON i.seller_id = s.seller_id
LEFT JOIN live_seller_stats d ON s.seller_id = d.seller_id
GROUP BY o.order_id, order_purchase_timestamp, order_estimated_delivery_date, customer_state, seller_state
""")
part("churn", """
SELECT customer_unique_id, max(order_purchase_timestamp) AS last_purchase_date,
       count(DISTINCT o.order_id) AS total_orders,
       CAST(sum(CAST(price + freight_value AS DECIMAL(18,4))) AS DOUBLE) AS total_spent,
       CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score
FROM r_customers c JOIN r_orders o ON c.customer_id = o.customer_id
JOIN r_items i ON o.order_id = i.order_id LEFT JOIN r_reviews v ON o.order_id = v.order_id
WHERE order_status = 'delivered' GROUP BY customer_unique_id
""")
part("recency", """
SELECT *, date_diff('day', last_purchase_date, (SELECT max(last_purchase_date) FROM churn)) AS recency_days FROM churn
""")
part("clustered", """
SELECT *, CASE WHEN avg_review_score < 2 THEN 0 WHEN total_orders > 3 THEN 1 ELSE 2 END AS cluster FROM recency
""")
part("summary", """
SELECT cluster, round(avg(recency_days), 2) AS recency_days, round(avg(total_orders), 2) AS total_orders,
       round(CAST(sum(CAST(total_spent AS DECIMAL(18,4))) AS DOUBLE) / count(total_spent), 2) AS total_spent,
       round(CAST(sum(CAST(avg_review_score AS DECIMAL(18,4))) AS DOUBLE) / count(avg_review_score), 2) AS avg_review_score
FROM clustered GROUP BY cluster
""")
part("risk_names", """
SELECT cluster, CASE
  WHEN cluster = (SELECT cluster FROM summary ORDER BY avg_review_score, cluster LIMIT 1) THEN 'High Risk (Churned / Unhappy)'
  WHEN cluster = (SELECT cluster FROM summary
                  WHERE cluster <> (SELECT cluster FROM summary ORDER BY avg_review_score, cluster LIMIT 1)
                  ORDER BY total_spent DESC, cluster LIMIT 1) THEN 'Low Risk (Loyal VIPs)'
  ELSE 'Medium Risk (Promising / Needs Nurturing)' END AS risk_profile
FROM summary
""")
part("profiles", "SELECT c.*, risk_profile FROM clustered c LEFT JOIN risk_names USING (cluster)")
part("baskets", """
SELECT o.order_id, customer_unique_id, order_purchase_timestamp, count(*) AS n_items,
       sum(price + freight_value) AS value
FROM r_orders o JOIN r_items i ON o.order_id = i.order_id JOIN r_customers c ON o.customer_id = c.customer_id
WHERE order_status = 'delivered' GROUP BY ALL
""")
part("daily", """
SELECT CAST(order_purchase_timestamp AS DATE) AS sale_date, category, count(order_item_id) AS units_sold,
       CAST(sum(price) AS DOUBLE) AS daily_revenue
FROM r_orders o JOIN r_items i ON o.order_id = i.order_id JOIN r_fine_names n ON i.product_id = n.product_id
WHERE order_status = 'delivered' GROUP BY 1, 2
""")
part("weeks_with_sales", """
SELECT category, CAST(date_trunc('week', sale_date) AS DATE) + 6 AS week_ending_date,
       CAST(sum(CAST(daily_revenue AS DECIMAL(18,4))) AS DOUBLE) AS weekly_revenue,
       CAST(sum(units_sold) AS BIGINT) AS weekly_units
FROM daily GROUP BY 1, 2
""")
part("spine", """
SELECT category, CAST(unnest(generate_series(min(week_ending_date), max(week_ending_date), INTERVAL 7 DAY)) AS DATE) AS week_ending_date
FROM weeks_with_sales GROUP BY category
""")
part("weekly", """
SELECT category, week_ending_date, coalesce(weekly_revenue, 0) AS weekly_revenue, coalesce(weekly_units, 0) AS weekly_units
FROM spine LEFT JOIN weeks_with_sales USING (category, week_ending_date)
""")
part("weekly_state", """
SELECT category, week_ending_date, weekly_revenue, weekly_units,
       list_reduce(list(weekly_revenue) OVER w, lambda e, x: CAST(0.6 AS DOUBLE) * e + CAST(0.4 AS DOUBLE) * x) AS ewma_4_revenue,
       list_reduce(list(CAST(weekly_units AS DOUBLE)) OVER w, lambda e, x: CAST(0.6 AS DOUBLE) * e + CAST(0.4 AS DOUBLE) * x) AS ewma_4_units
FROM weekly WINDOW w AS (PARTITION BY category ORDER BY week_ending_date ROWS UNBOUNDED PRECEDING)
""")
part("weekly_feat", """
SELECT category, week_ending_date, weekly_revenue, weekly_units,
       lag(weekly_revenue) OVER w AS lag_1_revenue, lag(weekly_units) OVER w AS lag_1_units,
       lag(ewma_4_revenue) OVER w AS ewma_4_revenue, lag(ewma_4_units) OVER w AS ewma_4_units,
       CAST(isoyear(week_ending_date) AS INTEGER) AS year, CAST(week(week_ending_date) AS INTEGER) AS week_of_year
FROM weekly_state WINDOW w AS (PARTITION BY category ORDER BY week_ending_date)
""")
part("train_rows", "SELECT * FROM weekly_feat WHERE lag_1_revenue IS NOT NULL")
part("test_rows", """
SELECT * FROM train_rows WHERE week_ending_date >= (SELECT max(week_ending_date) - 56 FROM train_rows)
""")
