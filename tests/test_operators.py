"""Edge cases of the general operators on small frames."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercato.functions import dates, numbers, scores, text
from mercato.operators import guards, knn, quality, quantiles, sampling, scan, series
from mercato.plans import retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_scans_with_any_number_of_levels(spark, levels):
    source = random.Random(1)
    data = [(k, p, source.choice([None, f"t{p}"]), source.randrange(5)) for k in "ab" for p in source.sample(range(200), 90)]
    df = spark.createDataFrame(data, "k string, p long, t string, v int")
    total = scan.running_total(df, ["k"], "p", "v", "total", block_rows=4, levels=levels)
    found = scan.dense_index(
        scan.carry_forward(total, ["k"], "p", "t", "title", block_rows=4, levels=levels),
        ["k"], "p", "nth", block_rows=4, levels=levels,
    )
    expected = pd.DataFrame(data, columns=["k", "p", "t", "v"]).sort_values(["k", "p"])
    expected["total"] = expected.groupby("k")["v"].cumsum()
    expected["title"] = expected.groupby("k")["t"].ffill()
    expected["nth"] = expected.groupby("k").cumcount()
    want = [tuple(None if pd.isna(x) else x for x in r) for r in expected[["k", "p", "total", "title", "nth"]].itertuples(index=False)]
    assert rows(found.select("k", "p", "total", "title", "nth"), "k", "p") == want


def test_index_over_strings(spark):
    ids = [f"r{i * 7919 % 1000}" for i in range(500)]
    found = scan.ordered_index(spark.createDataFrame([(i,) for i in ids], "id string").repartition(5), "id", "nth").collect()
    assert {r["id"]: r["nth"] for r in found} == {x: n for n, x in enumerate(sorted(ids))}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_quantiles_equal_numpy(spark, n):
    source = random.Random(n)
    values = [float(source.choice([1, 2, 3, source.random()])) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = quantiles.quantile_map(df, ["x"], probs)["x"]
    assert found == pytest.approx([float(np.quantile(values, p)) for p in probs])


def test_quantiles_with_narrow_brackets(spark):
    df = spark.range(300_000).select(((F.col("id") * 7919) % 300_007).cast("double").alias("x"), F.lit(5.0).alias("y"))
    values = df.select("x").toPandas()["x"].to_numpy()
    found = quantiles.quantile_map(df, ["x", "y"], [0.1, 0.5, 0.9])
    assert found["x"] == pytest.approx([float(np.quantile(values, p)) for p in (0.1, 0.5, 0.9)])
    assert found["y"] == [5.0, 5.0, 5.0]


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]).count() == 0


def test_weekly_series_equal_pandas(spark):
    source = random.Random(3)
    start = dt.date(2024, 11, 4)
    data = [
        (c, start + dt.timedelta(days=source.randrange(120)), float(source.randrange(1000)) / 4, source.randrange(5))
        for c in "abc" for _ in range(25)
    ] + [("single", dt.date(2024, 12, 30), 8.0, 2)]
    daily = spark.createDataFrame(data, "category string, day date, revenue double, units long")
    sums = {"revenue": F.sum("revenue"), "units": F.sum("units")}
    weekly = series.weekly_resample(daily, "category", "day", sums, "week")
    state = series.ewma_state(weekly, "category", "week", {"revenue": "e"})
    found = series.lag_features(state, "category", "week", {"units": "lag", "e": "e_before"}).withColumns({
        "year": dates.iso_year(F.col("week")), "number": dates.iso_week(F.col("week")),
    })

    pdf = pd.DataFrame(data, columns=["category", "day", "revenue", "units"])
    pdf["day"] = pd.to_datetime(pdf["day"])
    want = pdf.groupby("category").resample("W", on="day")[["revenue", "units"]].sum().reset_index()
    want["e"] = want.groupby("category")["revenue"].transform(lambda x: x.ewm(span=4, adjust=False).mean())
    want["lag"] = want.groupby("category")["units"].shift(1)
    want["e_before"] = want.groupby("category")["e"].shift(1)
    calendar = want["day"].dt.isocalendar()
    got = found.orderBy("category", "week").toPandas()
    assert got["week"].astype(str).tolist() == want["day"].dt.strftime("%Y-%m-%d").tolist()
    for ours, theirs in [("revenue", "revenue"), ("units", "units"), ("e", "e"), ("lag", "lag"), ("e_before", "e_before")]:
        np.testing.assert_allclose(got[ours].astype(float), want[theirs].astype(float), rtol=1e-12)
    assert got["year"].tolist() == calendar["year"].tolist()
    assert got["number"].tolist() == calendar["week"].tolist()


def test_iso_year_at_the_turn_of_the_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 29),), (dt.date(2024, 12, 30),)], "d date")
    found = df.select("d", dates.iso_year(F.col("d")), dates.iso_week(F.col("d")), dates.week_ending(F.col("d")))
    assert rows(found, "d") == [
        (dt.date(2024, 12, 29), 2024, 52, dt.date(2024, 12, 29)),
        (dt.date(2024, 12, 30), 2025, 1, dt.date(2025, 1, 5)),
    ]


def test_time_split_keeps_the_cutoff_week_in_the_test_part(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7) + dt.timedelta(weeks=i),) for i in range(12)], "week date")
    train, test = series.time_cutoff_split(df, "week")
    assert (train.count(), test.count()) == (3, 9)


def brute_force(queries, corpus, k):
    out = []
    for q, a in queries:
        near = sorted((float(((np.float64(a) - np.float64(b)) ** 2).sum()), c) for c, b in corpus)[:k]
        out += [(q, c, round(d, 9), n + 1) for n, (d, c) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("pivots, block_rows", [(None, knn.BLOCK_ROWS), (None, 16), (8, 16), (1, 50)])
def test_nearest_neighbours_equal_brute_force(spark, pivots, block_rows):
    source = np.random.default_rng(5)
    # A third of the corpus is one and the same vector: one hot cell full of ties.
    points = source.normal(size=(300, 6)).astype(np.float32)
    points[::3] = points[0]
    asked = source.normal(size=(40, 6)).astype(np.float32)
    asked[7] = points[0]
    corpus = [(int(i), p.tolist()) for i, p in enumerate(points)]
    queries = [(f"q{i}", p.tolist()) for i, p in enumerate(asked)]
    left = spark.createDataFrame(queries, "query_id string, embedding array<float>").repartition(3)
    right = spark.createDataFrame(corpus, "doc_id long, embedding array<float>").repartition(5)
    found = knn.knn_topk(left, right, ["query_id"], "doc_id", 5, pivots=pivots, block_rows=block_rows)
    got = [(q, c, round(d, 9), n) for q, c, d, n in rows(found, "query_id", "rank")]
    assert sorted(got) == brute_force(queries, corpus, 5)


def test_nearest_neighbours_of_few_or_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert rows(knn.knn_topk(asked, one, ["query_id"], "doc_id", 5), "query_id") == [(9, 1, 0.0, 1)]
    assert knn.knn_topk(asked, one.limit(0), ["query_id"], "doc_id", 5).count() == 0
    assert knn.knn_topk(asked.limit(0), one, ["query_id"], "doc_id", 5).count() == 0


def test_pruned_cells_lose_nothing(spark):
    source = np.random.default_rng(6)
    centers = source.normal(size=(10, 4)) * 50
    points = (centers[source.integers(0, 10, 500)] + source.normal(size=(500, 4))).astype(np.float32)
    corpus = [(int(i), p.tolist()) for i, p in enumerate(points)]
    queries = corpus[:50]
    left = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    right = spark.createDataFrame(corpus, "doc_id long, embedding array<float>")
    found = knn.knn_topk(left, right, ["query_id"], "doc_id", 3, pivots=20, block_rows=32)
    got = [(q, c, round(d, 9), n) for q, c, d, n in rows(found, "query_id", "rank")]
    assert sorted(got) == brute_force(queries, corpus, 3)


def test_key_checks(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z")], "id int, parent string")
    parent = spark.createDataFrame([("a",)], "name string")
    assert rows(quality.check_primary_key(child, ["id"]), "id") == [(None, 1), (1, 2)]
    assert rows(quality.check_foreign_key(child, "parent", parent, "name"), "parent") == [("z", 1)]


def test_profile_of_nulls_and_texts(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, None), (None, None)], "n double, t string")
    found = {r["column"]: r for r in quality.profile_table(df).collect()}
    assert (found["n"]["n_null"], found["n"]["mean"], found["n"]["median"]) == (1, 2.0, 2.0)
    assert (found["t"]["n_null"], found["t"]["mean"], found["t"]["median"]) == (2, None, None)


def test_cast_keeps_nulls_and_rejects_what_cannot_be_read(spark):
    from pyspark.sql.types import IntegerType, StructType

    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    kept, rejected = quality.cast_schema(df, StructType().add("a", IntegerType()))
    assert rows(kept, "a") == [(None,), (1,)]
    assert rows(rejected, "a") == [("x",)]


def test_labels_like_python(spark):
    values = [0.25, 0.75, 0.125, 0.5, 1234567.005, 0.15, -3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", numbers.dollar_label(F.col("v")), numbers.percent_label(F.col("v") / 100), numbers.units_label(F.col("v"))).collect()
    for v, dollars, percent, units in found:
        assert dollars in (f"${v:,.2f}", f"$-{abs(v):,.2f}")
        assert percent == f"{v / 100 * 100:.1f}%"
        assert units == f"{int(v)} units"


def test_strip_and_capture_like_python(spark):
    import re

    texts = ["  a\n", " b ", "\x1cc\x1f", "", "Title:\n  Next line", "x Title: One \r two\nthree"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", text.strip(F.col("t")), text.capture_first(F.col("t"), r"Title:\s*(.+)")).collect()
    for t, stripped, captured in found:
        match = re.search(r"Title:\s*(.+)", t)
        assert stripped == t.strip()
        assert captured == (match.group(1) if match else None)


def test_score_replies(spark):
    df = spark.createDataFrame([("8, 2,10",), ("8,x",), ("7.5",), ("",), ("3,",)], "reply string")
    found = {r[0]: r[1] for r in df.select("reply", scores.parse_scores(F.col("reply"))).collect()}
    assert found == {"8, 2,10": [8, 2, 10], "8,x": None, "7.5": None, "": None, "3,": None}


def test_judge_replies(spark):
    good = '{"context_relevance": 9, "faithfulness": 8, "answer_relevance": 7, "reasoning": "fits"}'
    df = spark.createDataFrame([(good,), ("{broken",), ('{"faithfulness": 8}',), (None,)], "reply string")
    found = {r[0]: tuple(r[1]) for r in df.select("reply", scores.parse_judge_reply(F.col("reply"))).collect()}
    failed = (1, 1, 1, "Failed to judge.")
    assert found == {good: (9, 8, 7, "fits"), "{broken": failed, '{"faithfulness": 8}': (1, 8, 1, "Failed to judge."), None: failed}


def test_guard(spark):
    df = spark.createDataFrame([("None",), ("NULL",), ("",), (None,), ("toys",)], "e string")
    good, bad = guards.entity_guard(df, "e")
    assert rows(good, "e") == [("toys",)]
    assert bad.count() == 4


def test_random_sample_takes_all_of_a_small_group(spark):
    df = spark.range(100).select(F.when(F.col("id") < 3, "small").otherwise("big").alias("g"), "id")
    found = dict(sampling.random_sample(df, "g", "id", 10).groupBy("g").count().collect())
    assert found == {"small": 3, "big": 10}
    again = sampling.random_sample(df.repartition(7), "g", "id", 10)
    assert again.exceptAll(sampling.random_sample(df, "g", "id", 10)).count() == 0


def test_large_samples_are_ranked_in_parts(spark, monkeypatch):
    df = spark.range(500).select(F.lit("hot").alias("g"), "id")
    plain = sampling.random_sample(df, "g", "id", 40)
    monkeypatch.setattr(sampling, "SALTS", 1)
    assert rows(sampling.random_sample(df, "g", "id", 40), "id") == rows(plain, "id")


def test_split_random_is_a_partition(spark):
    df = spark.range(2000)
    train, test = sampling.split_random(df, "id")
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert 0.77 < train.count() / 2000 < 0.83


def test_days_that_are_missing_belong_to_no_week(spark):
    daily = spark.createDataFrame([("a", dt.date(2024, 1, 3), 2.0), ("a", None, 5.0)], "category string, day date, revenue double")
    found = series.weekly_resample(daily, "category", "day", {"revenue": F.sum("revenue")}, "week").collect()
    assert [(r["week"], r["revenue"]) for r in found] == [(dt.date(2024, 1, 7), 2.0)]


def test_missing_vectors_take_no_part(spark):
    rows_ = [(1, [0.0, 1.0]), (2, None), (3, [1.0, 1.0])]
    corpus = spark.createDataFrame(rows_, "doc_id long, embedding array<double>")
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    found = knn.knn_topk(asked, corpus, ["query_id"], "doc_id", 2).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in found) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_texts_are_cut_before_headers_only(spark):
    df = spark.createDataFrame([("a\ue000b\n1.0 c\nd\n2.0 e",)], "t string")
    assert df.select(text.split_before(F.col("t"), r"[1-9]\.0 ")).first()[0] == ["a\ue000b", "1.0 c\nd", "2.0 e"]


def test_judge_replies_keep_what_can_be_read(spark):
    replies = [
        '{"context_relevance": 8.0, "faithfulness": 7, "answer_relevance": 9, "reasoning": "ok"}',
        '{"context_relevance": 8, "faithfulness": 7, "answer_relevance": 9}', '{"context_relevance": 8, "faithf', "no json", None]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    found = [tuple(r[0]) for r in df.select(scores.parse_judge_reply(F.col("r"))).collect()]
    low = (1, 1, 1, "Failed to judge.")
    assert found == [(8, 7, 9, "ok"), (8, 7, 9, "Failed to judge."), low, low, low]


def test_labels_of_no_number(spark):
    df = spark.createDataFrame([(12.7,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.units_label(F.col("x"))).collect()] == ["12 units", None, None]


def test_a_task_has_a_bounded_share_of_corpus_and_queries(spark, monkeypatch):
    source = np.random.default_rng(9)
    points = source.normal(size=(600, 5)).astype(np.float32)
    data = [(int(i), p.tolist()) for i, p in enumerate(points)]
    corpus = spark.createDataFrame(data, "doc_id long, embedding array<float>").repartition(3)
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    # A group has at most 64 vectors and a part about 64 queries, so nine tenths of the queries of a group are elsewhere.
    monkeypatch.setattr(knn, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(knn, "PART_BLOCKS", 4)
    found = knn.knn_topk(asked, corpus, ["query_id"], "doc_id", 4, block_rows=16)
    got = [(q, c, round(d, 9), n) for q, c, d, n in rows(found, "query_id", "rank")]
    assert sorted(got) == brute_force(data, data, 4)
    plan = found._jdf.queryExecution().toString()
    tasks = int(plan.split("RepartitionByExpression [", 1)[1].split("], ", 1)[1].split("\n")[0].split(",")[0])
    assert tasks >= (600 // 64) ** 2


def test_vectors_far_from_the_origin_and_of_any_size(spark):
    source = np.random.default_rng(10)
    for points in (source.normal(size=(200, 3)) + 1e6, source.normal(size=(200, 3)) * 1e25, source.normal(size=(200, 3)) * 1e-25):
        data = [(int(i), p.tolist()) for i, p in enumerate(points)]
        corpus = spark.createDataFrame(data, "doc_id long, embedding array<double>")
        found = knn.knn_topk(corpus.withColumnRenamed("doc_id", "query_id"), corpus, ["query_id"], "doc_id", 3, block_rows=32)
        got = {(q, n): c for q, c, _, n in rows(found, "query_id", "rank")}
        exact = ((points[:, None] - points[None]) ** 2).sum(axis=2)
        assert got == {(q, n + 1): int(c) for q in range(200) for n, c in enumerate(np.lexsort((np.arange(200), exact[q]))[:3])}


def test_shared_wordings_are_searched_once(spark):
    points = np.random.default_rng(11).normal(size=(60, 4))
    corpus = spark.createDataFrame([(int(i), p.tolist()) for i, p in enumerate(points)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(q, v, (q + v) % 70) for q in range(40) for v in range(3)], "query_id int, variant int, wording long")
    wordings = corpus.withColumnRenamed("doc_id", "wording")
    apart = queries.join(wordings, "wording").drop("wording")
    known = retrieval.retrieve_dedupe(apart, corpus)
    found = retrieval.retrieve_dedupe(queries, corpus, wordings=wordings)
    assert found.columns == known.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, known.collect()))


def test_more_keys_are_counted_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "KEYED_ROWS", 100, raising=False)
    rows = [(i, i % 7) for i in range(1000)] + [(None, 1)] * 300 + [(5, 5)] * 200 + [(6, None), (7, 1)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(3)
    found = quality.check_primary_key(df, ["a", "b"])
    assert sorted(found.collect(), key=str) == sorted([(None, 1, 300), (5, 5, 201), (6, None, 1)], key=str)
    counted = found.where("n_rows > 1").rdd.mapPartitions(lambda part: [1])
    assert counted.count() >= 15
    assert quality.check_primary_key(df.limit(0), ["a"]).collect() == []
