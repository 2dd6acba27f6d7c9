"""A small store with the edge cases of FIXTURES.md section 5."""

import datetime as dt
from types import SimpleNamespace

from mercato import schemas


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def store(spark):
    def frame(name, rows):
        schema = schemas.TABLES[name]
        padded = [tuple(r.get(f) for f in schema.fieldNames()) for r in rows]
        return spark.createDataFrame(padded, schema)

    def order(i, customer, status, bought, delivered, estimated):
        return {
            "order_id": i, "customer_id": customer, "order_status": status, "order_purchase_timestamp": ts(bought),
            "order_delivered_customer_date": ts(delivered), "order_estimated_delivery_date": ts(estimated),
        }

    from decimal import Decimal

    def item(order_id, n, product, seller, price, freight):
        return {
            "order_id": order_id, "order_item_id": n, "product_id": product, "seller_id": seller,
            "price": Decimal(price), "freight_value": Decimal(freight),
        }

    return SimpleNamespace(
        customers=frame("customers", [
            {"customer_id": "c1", "customer_unique_id": "u1", "customer_state": "SP", "customer_city": "x"},
            {"customer_id": "c2", "customer_unique_id": "u1", "customer_state": "SP", "customer_city": "x"},
            {"customer_id": "c3", "customer_unique_id": "u2", "customer_state": "RJ", "customer_city": "y"},
        ]),
        orders=frame("orders", [
            # late by hours on the estimated day
            order("o1", "c1", "delivered", "2017-01-01 10:00:00", "2017-01-10 12:00:00", "2017-01-10 00:00:00"),
            order("o2", "c2", "delivered", "2017-02-05 23:59:00", "2017-02-10 12:00:00", "2017-02-20 00:00:00"),
            # delivered without a date; not delivered
            order("o3", "c3", "delivered", "2017-02-01 10:00:00", None, "2017-02-20 00:00:00"),
            order("o4", "c3", "shipped", "2017-03-01 10:00:00", None, "2017-03-20 00:00:00"),
        ]),
        order_items=frame("order_items", [
            item("o1", 1, "p1", "s1", "10.00", "1.00"), item("o1", 2, "p1", "s1", "10.00", "1.00"),
            item("o1", 3, "p2", "s2", "5.00", "2.50"), item("o2", 1, "p2", "s2", "7.00", "0.50"),
            item("o3", 1, "p1", "s1", "3.00", "0.25"), item("o4", 1, "p1", "s3", "4.00", "0.25"),
        ]),
        products=frame("products", [
            {"product_id": "p1", "product_category_name": "brinquedos", "product_weight_g": 100.0,
             "product_length_cm": 2.0, "product_height_cm": 3.0, "product_width_cm": 4.0},
            {"product_id": "p2", "product_category_name": "sem_nome", "product_weight_g": None,
             "product_length_cm": 2.0, "product_height_cm": None, "product_width_cm": 4.0},
        ]),
        sellers=frame("sellers", [
            {"seller_id": "s1", "seller_state": "SP"}, {"seller_id": "s2", "seller_state": "RJ"},
            {"seller_id": "s3", "seller_state": "SP"},
        ]),
        translation=frame("product_category_name_translation", [
            {"product_category_name": "brinquedos", "product_category_name_english": "toys"},
        ]),
        order_reviews=frame("order_reviews", [
            {"review_id": "r1", "order_id": "o1", "review_score": 5, "review_comment_message": "good"},
            {"review_id": "r2", "order_id": "o1", "review_score": 1, "review_comment_title": "hm", "review_comment_message": " late "},
            {"review_id": "r3", "order_id": "o2", "review_score": 4},
        ]),
    )
