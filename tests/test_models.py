"""Training and scoring on small frames that can be learnt."""

import dataclasses
import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from mercato.ml import delay, embed, evaluate, forecast, preprocess, rfm
from mercato.ml.boosting import BoostedModel
from mercato.plans import churn, delivery, demand


@pytest.fixture(scope="module")
def orders(spark):
    """Late whenever the way is long and crosses a border; some values are missing."""
    source = random.Random(2)
    data = []
    for i in range(400):
        days, border = source.randrange(3, 30), source.randrange(2)
        data.append((
            f"o{i}", 1 + i % 12, 1 + i % 7, days, int(days > 20 and border == 1), source.random() * 50,
            None if i % 10 == 0 else source.random() * 1000, source.random() * 5000, border if i % 15 else None, source.random(),
        ))
    return spark.createDataFrame(
        data, "order_id string, purchase_month int, purchase_day_of_week int, estimated_days_to_deliver int, "
        "is_delayed int, total_freight_value double, total_weight_g double, total_volume_cm3 double, "
        "is_interstate int, seller_historical_delay_rate double")


SMALL = dataclasses.replace(delay.UNTUNED, trees=5, depth=3)


def test_delay_classifier_learns_saves_and_scores(spark, orders, tmp_path):
    model = delay.train_delay_classifier(orders, SMALL)
    told = [(r["prediction"], r["is_delayed"]) for r in delay.predict(model, orders).collect()]
    assert sum(a == b for a, b in told) > 0.95 * len(told)
    loaded = BoostedModel.load(spark, model.save(spark, str(tmp_path / "model")))
    first, second = [
        [r["probability_delayed"] for r in delay.score_delay(m, orders).orderBy("order_id").collect()] for m in (model, loaded)]
    assert first == second and all(0 <= p <= 1 for p in first)
    what_if = delivery.scenario_defaults(orders.where("is_interstate IS NOT NULL").limit(3).select(
        *delivery.FEATURES, *delivery.BINARY_FEATURES)).drop("valid")
    assert {r["status"] for r in delay.score_delay(model, what_if).collect()} == {"success"}


def test_random_search(spark, orders):
    bounds = {"depth": (2, 4), "step": (0.1, 0.3), "subsample": (0.6, 1.0), "trees": (2, 5)}
    drawn = delay.draw_settings(20, bounds)
    assert drawn == delay.draw_settings(20, bounds)
    for s in drawn:
        assert s.depth in (2, 3) and s.trees in (2, 3, 4) and 0.1 <= s.step <= 0.3 and 0.6 <= s.subsample <= 1
    full = delay.draw_settings()
    assert len(full) == 20 and all(3 <= s.depth <= 9 and 100 <= s.trees <= 499 and 0.01 <= s.step <= 0.31 for s in full)
    alone = delay.tune_random_search(orders, draws=3, folds=2, bounds=bounds)
    spread = delay.tune_random_search(orders.repartition(3), draws=3, folds=2, bounds=bounds, one_task=0)
    assert alone.scores == spread.scores and max(alone.scores) > 0.5
    assert alone.scores[alone.best] == max(alone.scores)
    a, b = ([r["p"] for r in orders.select(m.model.probability().alias("p")).collect()] for m in (alone, spread))
    assert a == b


def test_random_search_weighs_the_late_orders_once(spark, orders, monkeypatch):
    asked = []
    monkeypatch.setattr(delay, "class_weight", lambda *a, f=delay.class_weight: asked.append(1) or f(*a))
    bounds = {"depth": (2, 3), "step": (0.1, 0.3), "subsample": (0.6, 1.0), "trees": (1, 3)}
    search = delay.tune_random_search(orders, draws=4, folds=2, bounds=bounds)
    late = orders.groupBy("is_delayed").count().collect()
    n = {r["is_delayed"]: r["count"] for r in late}
    assert len(asked) == 1 and {s.positive for s in search.drawn} == {n[0] / n[1]}


def test_the_best_draw_is_fitted_on_all_rows_beside_the_other_draws(spark, orders, monkeypatch):
    """The last draw to be judged waits until a fit on all rows has begun; a better draw that comes late is still the one taken."""
    bounds = {"depth": (2, 5), "step": (0.1, 0.3), "subsample": (0.6, 1.0), "trees": (2, 7)}
    drawn = delay.draw_settings(4, bounds)
    last = min(range(4), key=lambda i: drawn[i].trees * drawn[i].depth)
    begun, fitted, groups = threading.Event(), [], set()

    def watched(binned, jobs, *rest, f=delay.boosting.fit_jobs, **options):
        (s, fold), *_ = jobs
        group = binned.sparkSession.sparkContext.getLocalProperty("spark.jobGroup.id")
        if fold is None:
            assert group and group not in groups
            groups.add(group)
            begun.set()
            fitted.append((s.trees, s.depth))
        else:
            # Giving up a fit on all rows must not end the others.
            assert group is None
            if s.step == drawn[last].step:
                assert begun.wait(60) and binned.sparkSession.sparkContext.getLocalProperty("spark.jobGroup.id") is None
        return f(binned, jobs, *rest, **options)

    monkeypatch.setattr(delay.boosting, "fit_jobs", watched)
    search = delay.tune_random_search(orders, draws=4, folds=2, bounds=bounds)
    assert begun.is_set() and (search.drawn[search.best].trees, search.drawn[search.best].depth) in fitted
    monkeypatch.undo()
    late_best = iter([0.1, 0.2, 0.3, 0.4])
    monkeypatch.setattr(delay, "mean_f1", lambda counted: next(late_best))
    better = delay.tune_random_search(orders, draws=4, folds=2, bounds=bounds)
    columns = delay.boosting.learn_columns(orders, delay.INPUTS)
    binned = delay.boosting.binned_rows(orders, "is_delayed", columns, 2)
    plain, = delay.boosting.fit_jobs(binned, [(better.drawn[better.best], None)], columns)
    assert [delay.boosting.written(t) for t in better.model.trees] == [delay.boosting.written(t) for t in plain]


def test_prepared_features(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (10.0, None), (None, 0)], "x double, b int")
    stage = preprocess.FeaturePreparer(["x"], ["b"]).fit(df)
    found = [tuple(r) for r in stage.transform(df).select("x_prepared", "b_prepared").collect()]
    # median 2.5 fills the gap; after filling the quartiles are 2, 2.5 and 3
    assert found == [(-1.5, 1.0), (-0.5, 1.0), (0.5, 0.0), (7.5, 0.0), (0.0, 0.0)]


def test_mode_is_the_smallest_of_equals(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (0,), (None,)], "b int")
    assert preprocess.modes(df, ["b"]) == {"b": 0}


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [r[0] for r in preprocess.scale_standard(df, df, ["x"]).collect()] == [0.0, 0.0]
    assert [r[0] for r in preprocess.scale_robust(df, df, ["x"]).collect()] == [0.0, 0.0]


def test_report_of_a_class_never_predicted(spark):
    matrix = spark.createDataFrame([(0, 0, 8), (1, 0, 2)], "actual int, predicted int, n long")
    found = {r["class"]: r for r in evaluate.classification_report(matrix).collect()}
    assert (found["1"]["precision"], found["1"]["recall"], found["1"]["f1"], found["1"]["support"]) == (0.0, 0.0, 0.0, 2)
    assert found["accuracy"]["precision"] == 0.8
    assert found["macro avg"]["recall"] == 0.5
    assert found["weighted avg"]["recall"] == 0.8


def test_segments_without_sales_have_no_relative_error(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 10.0, 8.0)], "category string, actual double, predicted double")
    found = {r["category"]: r["error_pct"] for r in evaluate.segment_metrics(df, "category", "actual", "predicted").collect()}
    assert found == {"a": 0.0, "b": 20.0}


def test_customer_groups(spark):
    start = dt.datetime(2018, 1, 1)
    groups = [(0, 1, 50.0, 1.0), (300, 2, 60.0, 4.5), (10, 9, 900.0, 4.8)]
    data = [
        (f"u{g}_{i}", start + dt.timedelta(days=days), orders + i % 2, spent + i, score if i else None)
        for g, (days, orders, spent, score) in enumerate(groups) for i in range(12)]
    profile = spark.createDataFrame(
        data, "customer_unique_id string, last_purchase_date timestamp_ntz, total_orders long, total_spent double, avg_review_score double")
    recent = churn.rfm_recency(profile)
    found = rfm.risk_profiles(rfm.train_rfm_clusters(recent, starts=3), recent)
    by_group = {
        (r["g"], r["risk_profile"]) for r in found.selectExpr("substr(customer_unique_id, 2, 1) g", "risk_profile").distinct().collect()}
    assert by_group == {("0", churn.HIGH_RISK), ("1", churn.MEDIUM_RISK), ("2", churn.LOW_RISK)}


def test_forecasts_answer_every_request(spark):
    day = dt.date(2024, 1, 1)
    daily = spark.createDataFrame(
        [(day + dt.timedelta(days=7 * w + o), c, 5 + w % 3, 100.0 * s + w) for c, s in (("toys", 1), ("health_beauty", 3)) for w in range(30) for o in (0, 2)],
        "sale_date date, category string, units_sold long, daily_revenue double")
    train = demand.weekly_features(daily)
    small = dataclasses.replace(forecast.MODEL, trees=5, depth=3, step=0.3)
    revenue, units = forecast.train_revenue_model(train, small), forecast.train_units_model(train, small)
    asked = spark.createDataFrame(
        [("Health Beauty", "revenue"), ("toys", "stock"), ("toys", "profit"), ("ships", "revenue")], "category string, forecast_type string")
    found = {(r["category"], r["forecast_type"]): r for r in forecast.forecast_next_week(asked, demand.next_week_features(daily), revenue, units).collect()}
    good = found["Health Beauty", "revenue"]
    assert (good["status"], good["metric"], good["target_date"]) == ("success", "Projected Revenue", "2024-08-04")
    assert 500 < float(good["value"].strip("$").replace(",", "")) < 700
    assert found["toys", "stock"]["value"].endswith(" units")
    assert found["toys", "profit"]["message"] == forecast.WRONG_TYPE
    assert found["ships", "revenue"]["message"] == "Category ships not found in Historical Data."
    unseen = forecast.predict(revenue, demand.next_week_features(daily).withColumn("category", F.lit("new")), "p")
    assert unseen.where("p IS NOT NULL").count() == 2


def test_embeddings_are_unit_vectors_and_find_their_text(spark):
    from mercato.plans import retrieval

    texts = ["late parcel from the seller", "blue toys for children", "refund policy for late orders"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = embed.fit_embedder(corpus)
    vectors = embed.embed_text(model, corpus)
    for r in vectors.collect():
        assert sum(v * v for v in r["embedding"]) == pytest.approx(1.0, abs=1e-5)
    asked = vectors.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("variant"), "embedding")
    best = retrieval.retrieve_dedupe(asked, vectors.drop("text"), 1).collect()
    assert {(r["query_id"], r["doc_id"]) for r in best} == {(0, 0), (1, 1), (2, 2)}


def test_a_column_without_values_is_prepared(spark):
    df = spark.createDataFrame([(1.0, None, 1), (3.0, None, 0)], "x double, y double, b int")
    for scaling in ("standard", "robust"):
        stage = preprocess.FeaturePreparer(["x", "y"], ["b"], scaling=scaling).fit(df)
        assert [r["y_prepared"] for r in stage.transform(df).collect()] == [0.0, 0.0]


def test_unknown_orders_and_missing_models_are_errors(spark, tmp_path):
    columns = [*delivery.FEATURES, *delivery.BINARY_FEATURES]
    good = [(i, *[float(i % 7 + n) for n in range(len(delivery.FEATURES))], i % 2, i % 2) for i in range(40)]
    kinds = ", ".join(f"{c} double" for c in delivery.FEATURES) + ", " + ", ".join(f"{c} int" for c in delivery.BINARY_FEATURES)
    train = spark.createDataFrame(good, f"order_id long, {kinds}, {delivery.LABEL} int")
    model = delay.train_delay_classifier(train, dataclasses.replace(SMALL, trees=2, depth=2))
    asked = spark.createDataFrame([(1, *good[1][1:-1], True), (2, *[None] * len(columns), True), (3, *good[3][1:-1], False)],
                                  f"order_id long, {kinds}, valid boolean")
    found = {r["order_id"]: r for r in delay.score_delay(model, asked).collect()}
    assert found[1]["status"] == "success" and found[1]["risk_level"] is not None
    for i in (2, 3):
        assert (found[i]["status"], found[i]["probability_delayed"], found[i]["risk_level"]) == ("error", None, None)
    path = model.save(spark, str(tmp_path / "model"))
    assert {r["order_id"]: r["status"] for r in delay.score_saved(path, asked).collect()} == {1: "success", 2: "error", 3: "error"}
    missing = delay.score_saved(str(tmp_path / "none"), asked).collect()
    assert {(r["status"], r["message"]) for r in missing} == {("error", delay.NO_MODEL)}


def test_features_are_made_once_for_learning_and_for_scoring(spark, sf_dir, monkeypatch):
    from mercato.registry import models

    made = []
    monkeypatch.setattr(delivery, "delivery_features", lambda *a, f=delivery.delivery_features: made.append(1) or f(*a))
    monkeypatch.setattr(models, "_stored", {})
    found = models.score_delay(spark, sf_dir)
    assert len(made) == 1
    plain = delay.score_delay(
        delay.load_model(spark, *models._stored.values()), delivery.scenario_defaults(models.scenarios(spark, sf_dir))).select(*found.columns)
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty() and found.count()
    made.clear()
    models._stored.clear()
    models.persist_model(spark, sf_dir)
    assert len(made) == 1
