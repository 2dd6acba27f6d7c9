"""Queries over the column functions, quality checks, filters and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato import schemas
from mercato.binding import bind, table
from mercato.functions import dates, numbers, scores, text
from mercato.operators import guards, quality, sampling, scan
from mercato.plans import chunking, delivery, evaluation
from mercato.registry.base import part, query

def bought():
    return F.col("order_purchase_timestamp")


def _orders(spark, d):
    return bind(spark, d).orders


@query("dt_month", "SELECT order_id, CAST(month(order_purchase_timestamp) AS INTEGER) AS month FROM r_orders")
def dt_month(spark, d):
    return _orders(spark, d).select("order_id", dates.month_of(bought()).alias("month"))


@query("dt_dayofweek", "SELECT order_id, CAST(dayofweek(order_purchase_timestamp) + 1 AS INTEGER) AS weekday FROM r_orders")
def dt_dayofweek(spark, d):
    return _orders(spark, d).select("order_id", dates.day_of_week(bought()).alias("weekday"))


@query("dt_datediff", "SELECT event_id, CAST(date_diff('day', TIMESTAMP '2023-12-25 18:30:00', ts) AS INTEGER) AS days FROM events")
def dt_datediff(spark, d):
    start = F.lit("2023-12-25 18:30:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", dates.calendar_days(F.col("ts"), start).alias("days"))


@query("dt_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def dt_date(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))


@query("dt_iso_year_week", """
SELECT order_id, CAST(isoyear(order_purchase_timestamp) AS INTEGER) AS iso_year,
       CAST(week(order_purchase_timestamp) AS INTEGER) AS iso_week FROM r_orders
""")
def dt_iso_year_week(spark, d):
    return _orders(spark, d).select(
        "order_id", dates.iso_year(bought()).alias("iso_year"), dates.iso_week(bought()).alias("iso_week")
    )


@query("dt_parse_format_add", """
SELECT event_id, strftime(CAST(ts AS DATE) + 7, '%Y-%m-%d') AS next_week, CAST(ts AS DATE) - 56 AS cutoff,
       strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed FROM events
""")
def dt_parse_format_add(spark, d):
    day = F.to_date("ts")
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select(
        "event_id",
        dates.iso_text(F.date_add(day, 7)).alias("next_week"),
        F.date_sub(day, 56).alias("cutoff"),
        written.cast("timestamp_ntz").alias("parsed"),
    )


@query("num_volume", """
SELECT product_id, product_length_cm * product_height_cm * product_width_cm AS volume FROM r_products
""")
def num_volume(spark, d):
    size = [F.col(f"product_{side}_cm") for side in ("length", "height", "width")]
    return bind(spark, d).products.select("product_id", numbers.volume(*size).alias("volume"))


@query("num_round_int_abs", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 1000, 2) AS rounded,
       CAST(trunc(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) AS whole,
       sqrt(abs(CAST(embedding[1] AS DOUBLE))) AS root FROM embeddings
""")
def num_round_int_abs(spark, d):
    first = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.round(first * 1000, 2).alias("rounded"),
        numbers.whole_part(first * 1000).alias("whole"),
        F.sqrt(F.abs(first)).alias("root"),
    )


@query("null_handling", """
SELECT review_id, coalesce(review_comment_title, '') AS title, nullif(review_score, 5) AS below_top,
       1.0::DOUBLE / nullif(review_score - 1, 0) AS ratio FROM r_reviews
""")
def null_handling(spark, d):
    score = F.col("review_score")
    return bind(spark, d).order_reviews.select(
        "review_id",
        F.coalesce("review_comment_title", F.lit("")).alias("title"),
        F.nullif(score, F.lit(5)).alias("below_top"),
        numbers.safe_ratio(F.lit(1.0), score - 1).alias("ratio"),
    )


@query("fmt_number", """
SELECT o_orderkey AS order_id, format('{:.1f}%', o_totalprice / 500000 * 100) AS share,
       format('${:,.2f}', o_totalprice) AS dollars, CAST(trunc(o_totalprice) AS BIGINT) || ' units' AS units FROM orders
""")
def fmt_number(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        numbers.percent_label(price / 500000).alias("share"),
        numbers.dollar_label(price).alias("dollars"),
        numbers.units_label(price).alias("units"),
    )


@query("str_normalize_category", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS category FROM part")
def str_normalize_category(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_category(F.col("p_name")).alias("category"))


@query("str_trim", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS trimmed FROM documents
""")
def str_trim(spark, d):
    padded = F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\n \n"))
    return table(spark, d, "documents").select("doc_id", text.strip(padded).alias("trimmed"))


@query("str_regex_remove", r"""
SELECT doc_id, regexp_replace(text, 'Licensed under the [A-Za-z]+ License, Version \d+', '', 'g') AS cleaned FROM documents
""")
def str_regex_remove(spark, d):
    footer = r"Licensed under the [A-Za-z]+ License, Version \d+"
    return table(spark, d, "documents").select("doc_id", text.remove_pattern(F.col("text"), footer).alias("cleaned"))


@query("str_regex_split_lookahead", r"""
SELECT doc_id, CAST(unnest(generate_series(0, len(pieces) - 1)) AS INTEGER) AS nth, unnest(pieces) AS piece
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n([A-M])', chr(57344) || '\1', 'g'), chr(57344)) AS pieces FROM documents)
""")
def str_regex_split_lookahead(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode(text.split_before(F.col("text"), "[A-M]")).alias("nth", "piece")
    )


@query("str_regex_capture", r"SELECT doc_id, nullif(regexp_extract(text, 'The\s*(.+)', 1), '') AS title FROM documents")
def str_regex_capture(spark, d):
    return table(spark, d, "documents").select("doc_id", text.capture_first(F.col("text"), r"The\s*(.+)").alias("title"))


@query("str_review_text", """
SELECT review_id, 'Title: ' || coalesce(review_comment_title, '') || chr(10) || 'Message: ' || review_comment_message AS text
FROM r_reviews WHERE review_comment_message IS NOT NULL
""")
def str_review_text(spark, d):
    return bind(spark, d).order_reviews.dropna(subset=["review_comment_message"]).select(
        "review_id", text.review_text(F.col("review_comment_title"), F.col("review_comment_message")).alias("text")
    )


@query("str_parent_prefix", "SELECT doc_id, 'Parent Document: ' || source || chr(10) || chr(10) || text AS text FROM documents")
def str_parent_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", text.with_parent(F.col("source"), F.col("text")).alias("text"))


@query("str_enhanced_doc", """
SELECT doc_id, 'Title: ' || source || chr(10) || 'Summary: ' || lang || chr(10) || chr(10) || 'Content: ' || chr(10) || text AS document
FROM documents
""")
def str_enhanced_doc(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.enhanced_document(F.col("source"), F.col("lang"), F.col("text")).alias("document")
    )


# Score replies: good lists, and lists with an item that is no integer.
part("score_replies", """
SELECT event_id, CAST(floor(value) AS BIGINT) || ', ' || user_id || ',' ||
       CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '7.5' ELSE ' 3 ' END AS reply FROM events
""")


def score_replies(spark, d):
    kind = F.col("event_type")
    last = F.when(kind == "error", "n/a").when(kind == "view", "7.5").otherwise(" 3 ")
    whole = F.floor("value").cast("string")
    return table(spark, d, "events").select(
        "event_id", F.concat(whole, F.lit(", "), F.col("user_id").cast("string"), F.lit(","), last).alias("reply")
    )


@query("arr_parse_scores", """
SELECT event_id, CAST(len(scores) AS INTEGER) AS n, CAST(list_sum(scores) AS BIGINT) AS total FROM (
  SELECT event_id, CASE WHEN len(list_filter(s, lambda x: x IS NULL)) = 0 THEN s END AS scores FROM (
    SELECT event_id, list_transform(string_split(reply, ','),
           lambda x: CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN CAST(trim(x) AS BIGINT) END) AS s FROM score_replies))
""")
def arr_parse_scores(spark, d):
    parsed = scores.parse_scores(F.col("reply"))
    total = F.aggregate("scores", F.lit(0).cast("bigint"), lambda a, s: a + s)
    return score_replies(spark, d).select("event_id", parsed.alias("scores")).select(
        "event_id", F.when(F.col("scores").isNotNull(), F.size("scores")).alias("n"), total.alias("total")
    )


@query("json_judge", """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN 1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS context_relevance,
       CASE WHEN event_type = 'error' THEN 1 ELSE CAST(user_id AS INTEGER) END AS faithfulness,
       CASE WHEN event_type = 'error' THEN 1 ELSE 4 END AS answer_relevance,
       CASE WHEN event_type = 'error' THEN 'Failed to judge.' ELSE event_type END AS reasoning FROM events
""")
def json_judge(spark, d):
    """Judge replies written from the events; those of errors are cut off."""
    k = F.get_json_object("props", "$.k").cast("int")
    reply = F.to_json(F.struct(
        k.alias("context_relevance"), F.col("user_id").alias("faithfulness"),
        F.lit(4).alias("answer_relevance"), F.col("event_type").alias("reasoning"),
    ))
    cut = F.when(F.col("event_type") == "error", F.expr("substr(reply, 1, length(reply) - 5)")).otherwise(F.col("reply"))
    return (
        table(spark, d, "events").withColumn("reply", reply)
        .select("event_id", scores.parse_judge_reply(cut).alias("judge"))
        .select("event_id", "judge.*")
    )


@query("drop_null_text", "SELECT * FROM r_reviews WHERE review_comment_message IS NOT NULL")
def drop_null_text(spark, d):
    return bind(spark, d).order_reviews.dropna(subset=["review_comment_message"])


@query("select_drop_rename", """
SELECT order_id AS id, price, freight_value AS freight FROM (SELECT order_id, CAST(price AS DOUBLE) AS price,
       CAST(freight_value AS DOUBLE) AS freight_value FROM r_items)
""")
def select_drop_rename(spark, d):
    items = bind(spark, d).order_items.select("order_id", "seller_id", "price", "freight_value")
    return items.drop("seller_id").withColumnsRenamed({"order_id": "id", "freight_value": "freight"}).withColumns({
        "price": F.col("price").cast("double"), "freight": F.col("freight").cast("double"),
    })


@query("min_length_filter", r"""
SELECT conv_id, turn, text FROM conversations WHERE length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) >= 50
""")
def min_length_filter(spark, d):
    return chunking.min_length_filter(table(spark, d, "conversations").select("conv_id", "turn", "text"))


# Tasks whose entity is empty, null or none for some kinds of event.
part("tasks", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'None' WHEN 'click' THEN ''
       WHEN 'signup' THEN 'NULL' ELSE 'user ' || user_id END AS entity FROM events
""")


@query("entity_guard", """
SELECT event_id, entity, lower(coalesce(entity, '')) NOT IN ('', 'null', 'none') AS accepted FROM tasks
""")
def entity_guard(spark, d):
    kind = F.col("event_type")
    entity = (
        F.when(kind == "view", "None").when(kind == "click", "").when(kind == "signup", "NULL")
        .when(kind != "error", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    )
    tasks = table(spark, d, "events").select("event_id", entity.alias("entity"))
    good, bad = guards.entity_guard(tasks, "entity")
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


# What-if rows: features with gaps where the priority of the order is not given.
part("scenarios", """
SELECT f.order_id, CASE WHEN gap THEN NULL ELSE estimated_days_to_deliver END AS estimated_days_to_deliver,
       CASE WHEN gap THEN NULL ELSE total_freight_value END AS total_freight_value,
       CASE WHEN rush THEN NULL ELSE total_weight_g END AS total_weight_g, total_volume_cm3,
       CASE WHEN gap THEN NULL ELSE purchase_month END AS purchase_month,
       CASE WHEN gap THEN NULL ELSE purchase_day_of_week END AS purchase_day_of_week, is_interstate,
       CASE WHEN gap THEN NULL ELSE seller_historical_delay_rate END AS seller_historical_delay_rate
FROM features f JOIN (SELECT o_orderkey, o_orderpriority = '4-NOT SPECIFIED' AS gap, o_orderpriority = '1-URGENT' AS rush FROM orders)
  ON o_orderkey = order_id
""")


def scenarios(spark, d, rows=None):
    """What-if rows out of the features of delivered orders, or of ``rows`` that hold these already."""
    if rows is None:
        rows = delivery.delivery_features(bind(spark, d))
    flags = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("gap"),
        (F.col("o_orderpriority") == "1-URGENT").alias("rush"),
    )
    rows = rows.join(flags, "order_id")
    gaps = {c: F.when(~F.col("gap"), F.col(c)) for c in delivery.SCENARIO_DEFAULTS}
    gaps["total_weight_g"] = F.when(~F.col("rush"), F.col("total_weight_g"))
    return rows.withColumns(gaps).select("order_id", *schemas.WHAT_IF.fieldNames())


@query("scenario_defaults", """
SELECT order_id, coalesce(estimated_days_to_deliver, 11) AS estimated_days_to_deliver,
       coalesce(total_freight_value, 20.0) AS total_freight_value, total_weight_g, total_volume_cm3,
       coalesce(purchase_month, 6) AS purchase_month, coalesce(purchase_day_of_week, 2) AS purchase_day_of_week,
       is_interstate, coalesce(seller_historical_delay_rate, 0.08) AS seller_historical_delay_rate,
       total_weight_g IS NOT NULL AND total_volume_cm3 IS NOT NULL AND is_interstate IS NOT NULL AS valid
FROM scenarios
""")
def scenario_defaults(spark, d):
    return delivery.scenario_defaults(scenarios(spark, d))


@query("risk_threshold", """
SELECT o_orderkey AS order_id, p, CASE WHEN p IS NULL THEN 'error' ELSE 'success' END AS status,
       format('{:.1f}%', p * 100) AS delay_probability,
       CASE WHEN p >= 0.75 THEN 'High Risk of Delay' WHEN p IS NOT NULL THEN 'On Track' END AS risk_level,
       CASE WHEN p >= 0.75 THEN 'Upgrade to Expedited Shipping.' WHEN p IS NOT NULL THEN 'Standard Processing.' END AS recommendation
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 500000 END AS p FROM orders)
""")
def risk_threshold(spark, d):
    share = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 500000)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), share.alias("p"))
    return delivery.risk_threshold(rows, "p")


@query("cast_schema", """
SELECT event_id, CAST(value AS DECIMAL(12,2)) AS amount, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'kept' AS outcome
FROM events WHERE event_type <> 'error'
UNION ALL
SELECT event_id, NULL, NULL, 'rejected' FROM events WHERE event_type = 'error'
""")
def cast_schema(spark, d):
    """Events as text; the number of an error cannot be read."""
    from pyspark.sql.types import DecimalType, IntegerType, LongType, StructType

    raw = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", "none").otherwise(F.col("value").cast("string")).alias("amount"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    schema = StructType().add("event_id", LongType()).add("amount", DecimalType(12, 2)).add("k", IntegerType())
    kept, rejected = quality.cast_schema(raw, schema)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(rejected.select(
        F.col("event_id").cast("bigint").alias("event_id"), F.lit(None).cast("decimal(12,2)").alias("amount"),
        F.lit(None).cast("int").alias("k"), F.lit("rejected").alias("outcome"),
    ))


KEYED_PARTS = {
    "customers": "r_customers", "orders": "r_orders", "products": "r_products", "sellers": "r_sellers",
    "product_category_name_translation": "r_translation", "order_items": "r_items", "order_payments": "r_payments",
}


@query("check_primary_key", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, concat_ws('|', {', '.join(schemas.PRIMARY_KEYS[name])}) AS key, count(*) AS n_rows "
    f"FROM {rows} GROUP BY {', '.join(schemas.PRIMARY_KEYS[name])} "
    f"HAVING count(*) > 1 OR {' OR '.join(f'{c} IS NULL' for c in schemas.PRIMARY_KEYS[name])}"
    for name, rows in KEYED_PARTS.items()
))
def check_primary_key(spark, d):
    """The declared keys of all tables."""
    r = bind(spark, d)
    found = [
        quality.check_primary_key(getattr(r, name.replace("product_category_name_", "")), keys).select(
            F.lit(name).alias("table_name"), F.concat_ws("|", *keys).alias("key"), "n_rows")
        for name, keys in schemas.PRIMARY_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, found)


KEY_RULES = [
    ("orders", "customer_id", "customers", "r_orders", "r_customers"),
    ("order_items", "order_id", "orders", "r_items", "r_orders"),
    ("order_items", "product_id", "products", "r_items", "r_products"),
    ("order_items", "seller_id", "sellers", "r_items", "r_sellers"),
    ("order_payments", "order_id", "orders", "r_payments", "r_orders"),
    ("order_reviews", "order_id", "orders", "r_reviews", "r_orders"),
    ("products", "product_category_name", "translation", "r_products", "r_translation"),
]


@query("check_foreign_key", "\nUNION ALL\n".join(
    f"SELECT '{child}' AS child, '{column}' AS key_column, count(DISTINCT {column}) AS n_keys, count(*) AS n_rows "
    f"FROM {child_part} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {column} FROM {parent_part})"
    for child, column, _, child_part, parent_part in KEY_RULES
))
def check_foreign_key(spark, d):
    """Keys and rows without a parent, for every declared key and the category names."""
    r = bind(spark, d)
    counts = [
        quality.check_foreign_key(getattr(r, child), column, getattr(r, parent), column).agg(
            F.lit(child).alias("child"), F.lit(column).alias("key_column"),
            F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        )
        for child, column, parent, *_ in KEY_RULES
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("anti_orphans", """
SELECT customer_id, count(*) AS n_rows FROM (SELECT c_custkey AS customer_id FROM customer)
WHERE customer_id NOT IN (SELECT customer_id FROM r_orders WHERE order_status = 'delivered') GROUP BY 1
""")
def anti_orphans(spark, d):
    """Customers without any delivered order, as rows without a partner."""
    r = bind(spark, d)
    return quality.check_foreign_key(r.customers, "customer_id", r.orders.where(delivery.is_delivered()), "customer_id")


def _profile_sql(table_name: str, numeric: list[tuple[str, str]], other: list[tuple[str, str]]) -> str:
    rows = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null,
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
        quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM {table_name}"""
        for c, t in numeric
    ] + [
        f"""SELECT '{c}', '{t}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {table_name}"""
        for c, t in other
    ]
    return "\nUNION ALL\n".join(rows)


@query("profile_table", _profile_sql(
    "orders",
    [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double")],
    [("o_orderstatus", "string"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
))
def profile_table(spark, d):
    found = quality.profile_table(table(spark, d, "orders"))
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query("value_counts", 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1')
def value_counts(spark, d):
    return quality.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("tail_sample", "SELECT * FROM r_reviews WHERE review_comment_message IS NOT NULL ORDER BY review_id DESC LIMIT 1000")
def tail_sample(spark, d):
    reviews = bind(spark, d).order_reviews.dropna(subset=["review_comment_message"])
    return sampling.tail_sample(reviews, "review_id", 1000)


@query("random_sample", """
SELECT lang AS collection, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 24
""")
def random_sample(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("collection"), "doc_id")
    return sampling.random_sample(docs, "collection", "doc_id", 24)


@query("split_random", """
SELECT order_id, CASE WHEN substr(md5(order_id || '|42'), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS part FROM r_orders
""")
def split_random(spark, d):
    train, test = sampling.split_random(_orders(spark, d).select("order_id"), "order_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("row_index_id", """
SELECT review_id, 'doc_' || (row_number() OVER (ORDER BY review_id) - 1) AS id FROM r_reviews WHERE review_comment_message IS NOT NULL
""")
def row_index_id(spark, d):
    reviews = bind(spark, d).order_reviews.dropna(subset=["review_comment_message"]).select("review_id")
    numbered = scan.ordered_index(reviews, "review_id", "nth")
    return sampling.row_ids(numbered, "doc_", "nth").select("review_id", "id")


@query("collection_counts", "SELECT lang AS collection, count(*) AS n_documents FROM documents GROUP BY 1")
def collection_counts(spark, d):
    return evaluation.collection_counts(table(spark, d, "documents").withColumnRenamed("lang", "collection"))


@query("class_weight", """
SELECT CAST(count(*) FILTER (is_delayed = 0) AS DOUBLE) / count(*) FILTER (is_delayed = 1) AS class_weight FROM features
""")
def class_weight(spark, d):
    from mercato.ml.preprocess import class_weight as weight

    return weight(delivery.delivery_features(bind(spark, d)), delivery.LABEL)
