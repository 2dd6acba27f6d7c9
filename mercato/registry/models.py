"""Queries over preprocessing, model training, scoring and model scores."""

from __future__ import annotations

import dataclasses
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mercato.binding import bind, table
from mercato.ml import boosting, delay, evaluate, forecast, preprocess, rfm
from mercato.ml.trees import LEAST_GAIN, Settings, Tree
from mercato.operators import sampling, series
from mercato.plans import churn, delivery, demand
from mercato.registry.base import part, query
from mercato.registry.columns import scenarios
from mercato.session import scratch_path
from mercato.sources.files import materialize

# Orders whose price is unknown while they are being processed.
part("priced", "SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders")


def priced(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )


@query("impute_median", """
SELECT order_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM priced)) AS price FROM priced
""")
def impute_median(spark, d):
    rows = priced(spark, d)
    return preprocess.impute_median(rows, rows, ["price"])


# Whether an item crosses a state border, unknown for returned items.
part("borders", """
SELECT l_orderkey AS order_id, l_partkey AS product_id,
       CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END END AS is_interstate FROM lineitem
""")


@query("impute_mode", """
SELECT order_id, product_id, coalesce(is_interstate, (SELECT is_interstate FROM borders WHERE is_interstate IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, is_interstate LIMIT 1)) AS is_interstate FROM borders
""")
def impute_mode(spark, d):
    flag = F.when(F.col("l_tax") > 0.04, 1).otherwise(0)
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") != "R", flag).alias("is_interstate"),
    )
    return preprocess.impute_mode(rows, rows, ["is_interstate"])


@query("scale_robust", """
SELECT order_id, round((price - quantile_cont(price, 0.5) OVER ()) /
       (quantile_cont(price, 0.75) OVER () - quantile_cont(price, 0.25) OVER ()), 8) AS price FROM priced
""")
def scale_robust(spark, d):
    rows = priced(spark, d)
    return preprocess.scale_robust(rows, rows, ["price"]).withColumn("price", F.round("price", 8))


@query("scale_standard", """
SELECT order_id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 8) AS price FROM priced
""")
def scale_standard(spark, d):
    rows = priced(spark, d)
    return preprocess.scale_standard(rows, rows, ["price"]).withColumn("price", F.round("price", 8))


@query("scale_std_no_center", "SELECT order_id, round(price / stddev_pop(price) OVER (), 8) AS price FROM priced")
def scale_std_no_center(spark, d):
    rows = priced(spark, d)
    return preprocess.scale_std_no_center(rows, rows, ["price"]).withColumn("price", F.round("price", 8))


@query("encode_onehot", """
SELECT p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN NULL ELSE
       (SELECT count(DISTINCT p_type) FROM part q WHERE q.p_type < p.p_type AND q.p_type <> 'PROMO') END AS INTEGER) AS hot,
       CAST((SELECT count(DISTINCT p_type) FROM part WHERE p_type <> 'PROMO') AS INTEGER) AS size FROM part p
""")
def encode_onehot(spark, d):
    """Part types, fitted without one of them: the place of the 1, none for the unseen type."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"))
    model = Pipeline(stages=preprocess.encode_onehot()).fit(parts.where(F.col("category") != "PROMO"))
    hot = vector_to_array("category_vector")
    place = F.array_position(hot, F.lit(1.0)).cast("int")
    return model.transform(parts).select(
        "p_partkey", F.when(place > 0, place - 1).alias("hot"), F.size(hot).alias("size")
    )


_COLUMNS = delivery.FEATURES
_MEDIANS = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS fill_{c}" for c in _COLUMNS)
_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), fill_{c}) AS {c}" for c in _COLUMNS)
_WIDTHS = ", ".join(
    f"quantile_cont({c}, 0.5) AS mid_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS wide_{c}" for c in _COLUMNS)
_SCALED = ", ".join(f"round(({c} - mid_{c}) / CASE WHEN wide_{c} = 0 THEN 1 ELSE wide_{c} END, 8) AS {c}" for c in _COLUMNS)


@query("assemble_features", f"""
WITH medians AS (SELECT {_MEDIANS} FROM features),
common AS (SELECT is_interstate AS mode FROM features WHERE is_interstate IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT order_id, {_FILLED}, CAST(coalesce(is_interstate, mode) AS DOUBLE) AS is_interstate FROM features, medians, common),
widths AS (SELECT {_WIDTHS} FROM filled)
SELECT order_id, {_SCALED}, is_interstate FROM filled, widths
""")
def assemble_features(spark, d):
    """The prepared features of every training row, column by column."""
    rows = materialize(delivery.delivery_features(bind(spark, d)), "features")
    preparer = preprocess.FeaturePreparer(delivery.FEATURES, delivery.BINARY_FEATURES)
    prepared = preparer.fit(rows).transform(rows)
    names = zip([*delivery.FEATURES, *delivery.BINARY_FEATURES], preparer.outputs)
    return prepared.select("order_id", *[F.round(out, 8).alias(name) for name, out in names])


# A prediction by rule: late if the seller is late more often than the average.
part("guessed", """
SELECT order_id, is_delayed, CASE WHEN seller_historical_delay_rate > (SELECT avg(is_delayed) FROM features) THEN 1 ELSE 0 END AS guess
FROM features
""")
part("matrix", "SELECT is_delayed AS actual, guess AS predicted, count(*) AS n FROM guessed GROUP BY 1, 2")


def matrix(spark, d):
    rows = delivery.delivery_features(bind(spark, d)).select("is_delayed", "seller_historical_delay_rate")
    average = rows.agg(F.avg("is_delayed")).scalar()
    guess = F.when(F.col("seller_historical_delay_rate") > average, 1).otherwise(0)
    return evaluate.confusion_matrix(rows.withColumn("guess", guess), "is_delayed", "guess")


@query("confusion_matrix", "SELECT * FROM matrix")
def confusion_matrix(spark, d):
    return matrix(spark, d)


# A measure without any row to measure on is 0.
@query("classification_report", """
WITH per_class AS (
  SELECT c AS class, CAST(coalesce(sum(n) FILTER (actual = c), 0) AS BIGINT) AS support,
         coalesce(sum(n) FILTER (predicted = c), 0) AS guessed,
         coalesce(sum(n) FILTER (actual = c AND predicted = c), 0) AS hits
  FROM matrix, (SELECT actual AS c FROM matrix UNION SELECT predicted FROM matrix) GROUP BY c),
scored AS (
  SELECT CAST(class AS VARCHAR) AS class,
         coalesce(CAST(hits AS DOUBLE) / nullif(CAST(guessed AS DOUBLE), 0), 0) AS "precision",
         coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS recall,
         coalesce(CAST(2 * hits AS DOUBLE) / nullif(CAST(support + guessed AS DOUBLE), 0), 0) AS f1, support, hits
  FROM per_class),
total AS (SELECT CAST(sum(support) AS DOUBLE) AS n, CAST(sum(support) AS BIGINT) AS support, CAST(sum(hits) AS DOUBLE) AS hits FROM scored)
SELECT class, "precision", recall, f1, support FROM scored
UNION ALL SELECT 'accuracy', hits / n, hits / n, hits / n, support FROM total
UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', sum("precision" * support) / (SELECT n FROM total), sum(recall * support) / (SELECT n FROM total),
  sum(f1 * support) / (SELECT n FROM total), CAST(sum(support) AS BIGINT) FROM scored
""")
def classification_report(spark, d):
    return evaluate.classification_report(matrix(spark, d))


def naive_forecast(spark, d):
    """The test weeks, with the average known the week before as the forecast."""
    daily = demand.daily_category_sales(bind(spark, d, fine_categories=True))
    return series.time_cutoff_split(demand.weekly_features(daily), demand.WEEK)[1]


@query("regression_metrics", """
SELECT round(avg(abs(weekly_revenue - ewma_4_revenue)), 4) AS mae,
       round(sqrt(avg((weekly_revenue - ewma_4_revenue) * (weekly_revenue - ewma_4_revenue))), 4) AS rmse FROM test_rows
""")
def regression_metrics(spark, d):
    found = evaluate.regression_metrics(naive_forecast(spark, d), "weekly_revenue", "ewma_4_revenue")
    return found.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


SEGMENTS = """
SELECT 'revenue' AS measure, * FROM (
  SELECT category, CAST(sum(CAST(weekly_revenue AS DECIMAL(18,4))) AS DOUBLE) AS total,
         round(CAST(sum(CAST(weekly_revenue AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean_actual,
         round(avg(abs(weekly_revenue - ewma_4_revenue)), 4) AS mae,
         round(CASE WHEN avg(weekly_revenue) > 0 THEN avg(abs(weekly_revenue - ewma_4_revenue)) / avg(weekly_revenue) * 100 ELSE 0 END, 4) AS error_pct
  FROM test_rows GROUP BY category ORDER BY total DESC, category LIMIT 5)
"""


@query("segment_metrics", SEGMENTS + "UNION ALL" + SEGMENTS.replace("revenue", "units"))
def segment_metrics(spark, d):
    rows = naive_forecast(spark, d)

    def top(measure):
        found = evaluate.segment_metrics(rows, demand.KEY, f"weekly_{measure}", f"ewma_4_{measure}")
        return found.select(
            F.lit(measure).alias("measure"), "category", "total",
            *[F.round(c, 4).alias(c) for c in ("mean_actual", "mae", "error_pct")],
        )

    return top("revenue").unionByName(top("units"))


def delay_rows(spark, d):
    """The features of all delivered orders, computed once."""
    return materialize(delivery.delivery_features(bind(spark, d)), "features")


def split_delay(rows):
    return sampling.split_random(rows, "order_id")


def delay_parts(spark, d):
    """Training and test rows, computed once."""
    return split_delay(delay_rows(spark, d))


def boosted_sql(source: str, label: str, weight: str, numeric: list[str], categorical: list[str], s: Settings, unit: str, base: str) -> str:
    """Parts ``margin_0`` (before the first tree) to ``margin_<trees>`` over ``source``, step by step in SQL.

    The same method in other words: shares end where counts of values reach
    them, sums of gradients per node, feature and bin, the split with the
    largest gain. Categories are bins by name, put in order of gradient per weight.
    """
    names = [*numeric, *categorical]
    longs = " UNION ALL ".join(
        [f"SELECT rid, {i} AS f, CAST({c} AS DOUBLE) AS v, NULL AS name FROM rows" for i, c in enumerate(numeric)]
        + [f"SELECT rid, {i}, NULL, {c} FROM rows" for i, c in enumerate(categorical, len(numeric))])
    parts = [f"""
rows AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, CAST({label} AS DOUBLE) AS y FROM {source}),
one AS MATERIALIZED (SELECT {unit} AS unit, {base} AS base, {weight} AS positive FROM rows),
long AS MATERIALIZED ({longs}),
counted AS (SELECT f, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY f, v),
summed AS (SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY f) AS total FROM counted),
binned AS (
  SELECT f, v, coalesce(sum(CASE WHEN least({boosting.BINS - 1}, upto * {boosting.BINS} // total) > (upto - n) * {boosting.BINS} // total THEN 1 ELSE 0 END)
    OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM summed),
named AS (SELECT f, name, row_number() OVER (PARTITION BY f ORDER BY name) - 1 AS b FROM (SELECT DISTINCT f, name FROM long WHERE name IS NOT NULL)),
cells AS MATERIALIZED (
  SELECT rid, l.f, CAST(coalesce(q.b, k.b, -1) AS BIGINT) AS b, l.f >= {len(numeric)} AS sets
  FROM long l LEFT JOIN binned q ON l.f = q.f AND l.v = q.v LEFT JOIN named k ON l.f = k.f AND l.name = k.name),
margin_0 AS MATERIALIZED (SELECT rid, base AS m FROM rows, one)"""]
    first = "1 / (1 + exp(-m))"
    for t in range(1, s.trees + 1):
        if s.loss == "logistic":
            sums = f"""SELECT rid, round_even(w * (p - y) * unit, 0) AS g, round_even(w * (p * (1 - p)) * unit, 0) AS h
  FROM (SELECT rid, y, {first} AS p, CASE WHEN y = 1 THEN positive ELSE 1 END AS w, unit FROM margin_{t - 1} JOIN rows USING (rid), one)"""
        else:
            sums = f"SELECT rid, round_even((m - y) * unit, 0) AS g, unit AS h FROM margin_{t - 1} JOIN rows USING (rid), one"
        parts.append(f"grad_{t} AS MATERIALIZED ({sums})")
        parts.append(f"at_{t}_0 AS (SELECT rid, 1 AS node FROM rows)")
        for level in range(s.depth):
            key = f"{t}_{level}"
            parts.append(f"""
hist_{key} AS MATERIALIZED (
  SELECT node, f, sets, b, CAST(sum(CAST(g AS BIGINT)) AS DOUBLE) / any_value(unit) AS g, CAST(sum(CAST(h AS BIGINT)) AS DOUBLE) / any_value(unit) AS h
  FROM at_{key} JOIN grad_{t} USING (rid) JOIN cells USING (rid), one GROUP BY node, f, sets, b),
nodes_{key} AS (SELECT node, sum(g) AS tg, sum(h) AS th FROM hist_{key} WHERE f = 0 GROUP BY node),
ranked_{key} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY node, f ORDER BY CASE WHEN sets THEN g / h END, b) AS place FROM hist_{key} WHERE b >= 0),
cut_{key} AS (
  SELECT r.node, r.f, r.place, way, tg, th,
         sum(r.g) OVER (PARTITION BY r.node, r.f, way ORDER BY r.place) + way * coalesce(x.g, 0) AS gl,
         sum(r.h) OVER (PARTITION BY r.node, r.f, way ORDER BY r.place) + way * coalesce(x.h, 0) AS hl
  FROM ranked_{key} r JOIN nodes_{key} USING (node) LEFT JOIN (SELECT node, f, g, h FROM hist_{key} WHERE b = -1) x ON r.node = x.node AND r.f = x.f,
       (SELECT unnest([0, 1]) AS way)),
gain_{key} AS (
  SELECT *, gl * gl / (hl + {s.l2}::DOUBLE) + (tg - gl) * (tg - gl) / (th - hl + {s.l2}::DOUBLE) - tg * tg / (th + {s.l2}::DOUBLE) AS gain
  FROM cut_{key} WHERE hl >= {s.least_weight} AND th - hl >= {s.least_weight} AND th >= 2 * {s.least_weight}),
split_{key} AS MATERIALIZED (
  SELECT * FROM gain_{key} WHERE gain > {LEAST_GAIN}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, place, way) = 1),
at_{t}_{level + 1} AS MATERIALIZED (
  SELECT rid, CASE WHEN s.node IS NULL THEN a.node WHEN coalesce(r.place <= s.place, s.way = 1) THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
  FROM at_{key} a LEFT JOIN split_{key} s USING (node) LEFT JOIN cells c USING (rid, f) LEFT JOIN ranked_{key} r ON r.node = a.node AND r.f = c.f AND r.b = c.b)""")
        parts.append(f"""
leaf_{t} AS (
  SELECT node, -{s.step}::DOUBLE * (CAST(sum(CAST(g AS BIGINT)) AS DOUBLE) / any_value(unit)) / (CAST(sum(CAST(h AS BIGINT)) AS DOUBLE) / any_value(unit) + {s.l2}::DOUBLE) AS value
  FROM at_{t}_{s.depth} JOIN grad_{t} USING (rid), one GROUP BY node),
margin_{t} AS MATERIALIZED (
  SELECT rid, m + value AS m FROM margin_{t - 1} JOIN at_{t}_{s.depth} USING (rid) JOIN leaf_{t} USING (node))""")
    assert names
    return "WITH " + ",".join(parts)


WEIGHT = "CAST(count(*) FILTER (WHERE is_delayed = 0) AS DOUBLE) / count(*) FILTER (WHERE is_delayed = 1)"
SHORT_DELAY = dataclasses.replace(delay.UNTUNED, trees=2, depth=2)
DELAY_SQL = boosted_sql(
    "features", "is_delayed", WEIGHT, delivery.FEATURES, delivery.BINARY_FEATURES, SHORT_DELAY,
    f"pow(2, 26 - ceil(log2(greatest(1, {WEIGHT}))))", "0::DOUBLE")


@query("boosting_histogram", DELAY_SQL + """
SELECT f AS feature, b AS bin, CAST(g * unit AS BIGINT) AS gradient, CAST(h * unit AS BIGINT) AS weight FROM hist_1_0, one
""")
def boosting_histogram(spark, d):
    """The sums that the first split of the delay classifier is found with; bin -1 holds missing values."""
    rows = materialize(delivery.delivery_features(bind(spark, d)), "features")
    columns = boosting.learn_columns(rows, delay.INPUTS)
    jobs = [(delay.weighted(rows, delay.UNTUNED), None)]
    state = boosting.row_blocks(boosting.binned_rows(rows, delivery.LABEL, columns), jobs, columns, 8)
    sums = boosting.level_sums(state, [(0, 0, Tree(jobs[0][0].depth), [1])], jobs, [[]], columns)
    spans = columns.shape.spans

    def cells(found):
        _, (g, h) = found
        places = [(f, b, c) for f, span in enumerate(spans) for b, c in enumerate(range(span.start, span.stop))]
        return [(f, b if c + 1 < spans[f].stop else -1, int(g[c]), int(h[c])) for f, b, c in places if h[c]]

    return spark.createDataFrame(sums.flatMap(cells), "feature int, bin long, gradient long, weight long")


@query("boosting_two_trees", DELAY_SQL + """
SELECT order_id, round(1 / (1 + exp(-m)), 9) AS probability FROM margin_2 JOIN rows USING (rid)
""")
def boosting_two_trees(spark, d):
    """Probabilities after two small trees, grown level by level over all tasks."""
    rows = materialize(delivery.delivery_features(bind(spark, d)), "features")
    model = boosting.fit(rows, delivery.LABEL, delay.INPUTS, settings=delay.weighted(rows, SHORT_DELAY), one_task=0)
    return rows.select("order_id", F.round(model.probability(), 9).alias("probability"))


SHORT_DEMAND = dataclasses.replace(forecast.MODEL, trees=2, depth=2)


def demand_sql(target: str, features: list[str]) -> str:
    top = f"2 * max(abs(CAST({target} AS DOUBLE)))"
    return boosted_sql(
        "train_rows", target, "1::DOUBLE", features, [demand.KEY], SHORT_DEMAND,
        f"pow(2, 26 - ceil(log2(greatest(1, {top}))))", f"round(avg({target}), 4)")


def two_demand_trees(spark, d, target, features):
    daily = demand.daily_category_sales(bind(spark, d, fine_categories=True))
    rows = materialize(demand.weekly_features(daily), "weekly")
    model = forecast.train_forecaster(rows, target, features, SHORT_DEMAND)
    return rows.select(demand.KEY, demand.WEEK, F.round(model.margin(), 6).alias("predicted"))


@query("boosting_revenue_trees", demand_sql(*forecast.REVENUE) + """
SELECT category, week_ending_date, round(m, 6) AS predicted FROM margin_2 JOIN rows USING (rid)
""")
def boosting_revenue_trees(spark, d):
    """Revenue by two small trees with sets of categories."""
    return two_demand_trees(spark, d, *forecast.REVENUE)


@query("boosting_units_trees", demand_sql(*forecast.UNITS) + """
SELECT category, week_ending_date, round(m, 6) AS predicted FROM margin_2 JOIN rows USING (rid)
""")
def boosting_units_trees(spark, d):
    return two_demand_trees(spark, d, *forecast.UNITS)


_stored: dict[tuple[str, str, str], str] = {}


def stored_model(spark, d: str, name: str, fit) -> str:
    """Where the model of these tables lies; ``fit()`` is called only when no query of the session has stored it yet."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        _stored[key] = fit().save(spark, scratch_path(spark, name))
    return _stored[key]


def delay_model(spark, d: str, train) -> str:
    return stored_model(spark, d, "delay-model", lambda: delay.train_delay_classifier(train))


def report(model, rows):
    return evaluate.classification_report(evaluate.confusion_matrix(delay.predict(model, rows), delivery.LABEL, "prediction"))


@query("train_delay_classifier")
def train_delay_classifier(spark, d):
    """Report of the classifier on the test rows."""
    train, test = delay_parts(spark, d)
    return report(delay.train_delay_classifier(train), test)


@query("tune_random_search")
def tune_random_search(spark, d):
    """The twenty draws with their mean F1, and the F1 on the test rows of the best one and of the untuned model (draw -1)."""
    train, test = delay_parts(spark, d)
    # The untuned model is one task for long, so it is trained beside the search.
    with ThreadPoolExecutor(1) as pool:
        stored = pool.submit(inheritable_thread_target(spark)(delay_model), spark, d, train)
        search = delay.tune_random_search(train)
    late = F.col("class") == "1"
    untuned = delay.load_model(spark, stored.result())
    on_test = {i: report(m, test).where(late).select("f1").first() for i, m in ((search.best, search.model), (-1, untuned))}
    rows = [(-1, delay.UNTUNED, None), *((i, s, f1) for i, (s, f1) in enumerate(zip(search.drawn, search.scores)))]
    return spark.createDataFrame(
        [(i, s.depth, s.step, s.subsample, s.trees, f1, i == search.best, on_test[i]["f1"] if on_test.get(i) else None) for i, s, f1 in rows],
        "draw int, max_depth int, learning_rate double, subsample double, n_estimators int, mean_f1 double, best boolean, test_f1 double")


@query("score_delay")
def score_delay(spark, d):
    """All what-if rows scored by the stored classifier; they are made of the features that it learns from."""
    rows = delay_rows(spark, d)
    model = delay.load_model(spark, delay_model(spark, d, split_delay(rows)[0]))
    asked = delivery.scenario_defaults(scenarios(spark, d, rows))
    return delay.score_delay(model, asked).select("order_id", "status", "delay_probability", "risk_level", "recommendation")


@query("persist_model")
def persist_model(spark, d):
    """Scores of the test rows by the classifier as it was stored."""
    train, test = delay_parts(spark, d)
    return delay.score_saved(delay_model(spark, d, train), test).select("order_id", "probability_delayed", "risk_level")


_RFM = churn.FEATURES
_D = lambda a, b: " + ".join(["0::DOUBLE"] + [f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(len(_RFM))])
_X = ", ".join(f"x{i}" for i in range(len(_RFM)))
_RACE = lambda nth: f"-ln((('0x' || substr(md5(concat_ws('|', id, s, '{nth}', '{rfm.SEED}')), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52))"
_SEEDS = ",".join(f"""
seeds_{nth} AS MATERIALIZED (
  {f"SELECT * FROM seeds_{nth - 1} UNION ALL " if nth else ""}
  SELECT s, {nth} AS cl, unnest(x) FROM (
    SELECT s, arg_min({{{", ".join(f"'x{i}': x{i}::DOUBLE" for i in range(len(_RFM)))}}}, {{'race': race, 'id': id}}) AS x FROM (
      SELECT s, id, {_X}, {_RACE(nth)} / d AS race FROM (
        {f"SELECT c.s, p.id, {', '.join(f'p.x{i}' for i in range(len(_RFM)))}, min({_D('p', 'c')}) AS d FROM points p, seeds_{nth - 1} c GROUP BY ALL"
         if nth else f"SELECT s, id, {_X}, 1::DOUBLE AS d FROM points, (SELECT unnest(range({rfm.STARTS})) AS s)"})
      WHERE d > 0) GROUP BY s))""" for nth in range(rfm.CLUSTERS))
_MEANS = ", ".join(f"avg(f{i}) AS mean{i}, stddev_pop(f{i}) AS sd{i}" for i in range(len(_RFM)))


@query("train_rfm_clusters", f"""
WITH RECURSIVE fills AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m{i}" for i, c in enumerate(_RFM))} FROM recency),
filled AS (SELECT customer_unique_id AS id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), m{i}) AS f{i}" for i, c in enumerate(_RFM))} FROM recency, fills),
scales AS (SELECT {_MEANS} FROM filled),
points AS MATERIALIZED (
  SELECT id, {", ".join(f"CAST(round((f{i} - mean{i}) / CASE WHEN sd{i} = 0 THEN 1 ELSE sd{i} END * 1e6::DOUBLE) AS BIGINT) AS x{i}" for i in range(len(_RFM)))}
  FROM filled, scales),
{_SEEDS},
lloyd AS (
  SELECT 0 AS step, s, cl, {_X}, true AS moved FROM seeds_{rfm.CLUSTERS - 1}
  UNION ALL
  SELECT step + 1, s, cl, {", ".join(f"n{i}" for i in range(len(_RFM)))}, {" OR ".join(f"n{i} <> x{i}" for i in range(len(_RFM)))}
  FROM (
    SELECT l.*, {", ".join(f"coalesce(m{i}, l.x{i}) AS n{i}" for i in range(len(_RFM)))}
    FROM lloyd l LEFT JOIN (
      SELECT s, cl, {", ".join(f"CAST(sum(x{i}) AS DOUBLE) / count(*) AS m{i}" for i in range(len(_RFM)))} FROM (
        SELECT l.s, p.id, {", ".join(f"p.x{i}" for i in range(len(_RFM)))}, arg_min(l.cl, {{'d': {_D("p", "l")}, 'cl': l.cl}}) AS cl
        FROM points p, lloyd l GROUP BY ALL) GROUP BY s, cl) m ON l.s = m.s AND l.cl = m.cl
    WHERE l.s IN (SELECT s FROM lloyd WHERE moved) AND step < 300)),
centers AS MATERIALIZED (SELECT * FROM lloyd QUALIFY step = max(step) OVER (PARTITION BY s)),
costs AS (
  SELECT s, sum(CAST(round(d / 1e6::DOUBLE) AS BIGINT)) AS cost FROM (
    SELECT c.s, p.id, min({_D("p", "c")}) AS d FROM points p, centers c GROUP BY ALL) GROUP BY s),
chosen_start AS (
  SELECT row_number() OVER (ORDER BY {_X}) - 1 AS cl, {_X} FROM centers WHERE s = (SELECT arg_min(s, {{'cost': cost, 's': s}}) FROM costs)),
grouped AS MATERIALIZED (
  SELECT r.*, cl AS cluster FROM recency r JOIN (
    SELECT p.id, arg_min(b.cl, {{'d': {_D("p", "b")}, 'cl': b.cl}}) AS cl FROM points p, chosen_start b GROUP BY p.id) q ON r.customer_unique_id = q.id),
means AS (
  SELECT cluster, round(CAST(sum(CAST(total_spent AS DECIMAL(18,4))) AS DOUBLE) / count(total_spent), 2) AS total_spent,
         round(CAST(sum(CAST(avg_review_score AS DECIMAL(18,4))) AS DOUBLE) / count(avg_review_score), 2) AS avg_review_score
  FROM grouped GROUP BY cluster),
unhappy AS (SELECT cluster FROM means ORDER BY avg_review_score, cluster LIMIT 1),
loyal AS (SELECT cluster FROM means WHERE cluster <> (SELECT cluster FROM unhappy) ORDER BY total_spent DESC, cluster LIMIT 1)
SELECT customer_unique_id, CAST(cluster AS INTEGER) AS cluster,
       CASE WHEN cluster = (SELECT cluster FROM unhappy) THEN '{churn.HIGH_RISK}' WHEN cluster = (SELECT cluster FROM loyal) THEN '{churn.LOW_RISK}'
            ELSE '{churn.MEDIUM_RISK}' END AS risk_profile
FROM grouped
""")
def train_rfm_clusters(spark, d):
    """Every customer with cluster and risk profile, the best of ten starts."""
    profiles = materialize(churn.rfm_recency(churn.churn_profile(bind(spark, d))), "profiles")
    model = rfm.train_rfm_clusters(profiles)
    return rfm.risk_profiles(model, profiles).select("customer_unique_id", "cluster", "risk_profile")


def demand_models(spark, d):
    daily = materialize(demand.daily_category_sales(bind(spark, d)), "daily")
    train, test = series.time_cutoff_split(materialize(demand.weekly_features(daily), "weekly"), demand.WEEK)
    return daily, train, test


def against_average(model, test, target, average):
    """The error in the largest categories, beside that of the moving average."""
    rows = forecast.predict(model, test, "predicted")
    own = evaluate.segment_metrics(rows, demand.KEY, target, "predicted")
    naive = evaluate.segment_metrics(rows, demand.KEY, target, average)
    return own.join(naive.select(demand.KEY, F.col("mae").alias("ewma_mae"), F.col("error_pct").alias("ewma_error_pct")), demand.KEY)


@query("train_revenue_model")
def train_revenue_model(spark, d):
    _, train, test = demand_models(spark, d)
    return against_average(forecast.train_revenue_model(train), test, "weekly_revenue", "ewma_4_revenue")


@query("train_units_model")
def train_units_model(spark, d):
    _, train, test = demand_models(spark, d)
    return against_average(forecast.train_units_model(train), test, "weekly_units", "ewma_4_units")


@query("forecast_next_week")
def forecast_next_week(spark, d):
    """Revenue, units and a wrong type asked for every category, untranslated ones included."""
    daily, train, _ = demand_models(spark, d)
    revenue, units = (
        boosting.BoostedModel.load(spark, stored_model(spark, d, name, lambda fit=fit: fit(train)))
        for name, fit in (("revenue-model", forecast.train_revenue_model), ("units-model", forecast.train_units_model)))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("revenue", "inventory", "stock", "profit")]))
    asked = bind(spark, d).products.select(
        F.concat(F.col("product_category_name"), F.lit(" goods")).alias("category")
    ).distinct().withColumn("forecast_type", kinds)
    return forecast.forecast_next_week(asked, demand.next_week_features(daily), revenue, units)
