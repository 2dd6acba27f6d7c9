"""Declared schemas of the retail tables, feature sets and evaluation tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "money": T.DecimalType(12, 2),
    "time": T.TimestampNTZType(),
    "date": T.DateType(),
    "vector": T.ArrayType(T.FloatType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Timestamps carry no zone: the source text has none, and a plain wall-clock
# value gives the same month and day whatever the session time zone is.
TABLES = {
    "customers": _schema(
        customer_id="string", customer_unique_id="string", customer_zip_code_prefix="string",
        customer_city="string", customer_state="string",
    ),
    "orders": _schema(
        order_id="string", customer_id="string", order_status="string",
        order_purchase_timestamp="time", order_approved_at="time", order_delivered_carrier_date="time",
        order_delivered_customer_date="time", order_estimated_delivery_date="time",
    ),
    "order_items": _schema(
        order_id="string", order_item_id="int", product_id="string", seller_id="string",
        shipping_limit_date="time", price="money", freight_value="money",
    ),
    "products": _schema(
        product_id="string", product_category_name="string", product_name_lenght="int",
        product_description_lenght="int", product_photos_qty="int", product_weight_g="double",
        product_length_cm="double", product_height_cm="double", product_width_cm="double",
    ),
    "order_payments": _schema(
        order_id="string", payment_sequential="int", payment_type="string",
        payment_installments="int", payment_value="money",
    ),
    "sellers": _schema(
        seller_id="string", seller_zip_code_prefix="string", seller_city="string", seller_state="string",
    ),
    "product_category_name_translation": _schema(
        product_category_name="string", product_category_name_english="string",
    ),
    "order_reviews": _schema(
        review_id="string", order_id="string", review_score="int",
        review_comment_title="string", review_comment_message="string",
    ),
}

# Key rules of the tables above: column lists, and (child, column, parent).
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "product_category_name_translation": ["product_category_name"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
}
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("order_items", "seller_id", "sellers"),
    ("order_payments", "order_id", "orders"),
    ("order_reviews", "order_id", "orders"),
]

EVAL_CASE = _schema(query="string", collection="string", expected_ground_truth="string")

JUDGE_REPLY = _schema(context_relevance="int", faithfulness="int", answer_relevance="int", reasoning="string")

RUN_HISTORY = _schema(
    execution_time="time", total_test_cases="long", avg_context_relevance="double",
    avg_faithfulness="double", avg_answer_relevance="double", guardrail_accuracy="double",
)

WHAT_IF = _schema(
    estimated_days_to_deliver="int", total_freight_value="double", total_weight_g="double",
    total_volume_cm3="double", purchase_month="int", purchase_day_of_week="int",
    is_interstate="int", seller_historical_delay_rate="double",
)
