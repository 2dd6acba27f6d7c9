"""Files, collections and the run history."""

import datetime as dt
import json

from pyspark.sql import functions as F
from shop import store

from mercato import schemas, session
from mercato.plans import churn, delivery, metrics
from mercato.sources import files, history, vectors
from mercato.sources.store import ingest_store, open_store


def test_csv_keeps_quotes_breaks_and_blanks_and_reads_empty_as_null(spark, tmp_path):
    data = [(1, 'say "hi",\nthere'), (2, "  padded "), (3, None), (4, "back\\slash"), (5, "")]
    df = spark.createDataFrame(data, "id int, t string")
    path = files.write_csv(df, str(tmp_path / "t.csv"))
    found = files.read_csv(spark, path, df.schema, multiline=True).orderBy("id").collect()
    assert [tuple(r) for r in found] == [*data[:-1], (5, None)]


def test_manifest_goes_on_after_a_bad_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id,name\none,x\n")
    manifest = {
        str(tmp_path / "a.csv"): ("a", "id int, name string"),
        str(tmp_path / "b.csv"): ("b", "id int, name string"),
        str(tmp_path / "c.csv"): ("c", "id int, name string"),
    }
    found = files.ingest_manifest(spark, manifest, str(tmp_path / "tables")).collect()
    assert [tuple(r)[:3] for r in found] == [("a", 2, "loaded"), ("b", None, "failed"), ("c", None, "missing")]
    assert spark.read.parquet(str(tmp_path / "tables" / "a")).count() == 2


def test_json_array(spark, tmp_path):
    cases = [{"query": "q1", "collection": "c", "expected_ground_truth": "t"}, {"query": "q\n2", "collection": "c"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=4))
    found = files.read_json(spark, str(tmp_path / "cases.json"), schemas.EVAL_CASE, array=True)
    assert sorted(tuple(r) for r in found.collect()) == [("q\n2", "c", None), ("q1", "c", "t")]


def test_history_is_written_once_per_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert history.read_history(spark, path).count() == 0

    def run(day, score):
        return spark.createDataFrame([(dt.datetime(2026, 6, day), 50, score, score, score, 100.0)], schemas.RUN_HISTORY)

    history.append_run(run(1, 9.0), path)
    history.append_run(run(2, 8.0), path)
    history.append_run(run(2, 8.5), path)
    found = history.read_history(spark, path).orderBy("execution_time").collect()
    assert [(r["execution_time"].day, r["avg_faithfulness"]) for r in found] == [(1, 9.0), (2, 8.5)]


def test_collection_adds_only_new_ids(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", [1.0], "x"), ("b", [2.0], "y")], "id string, embedding array<float>, text string")
    vectors.add_to_collection(rows.where("id = 'a'"), path)
    vectors.add_to_collection(rows, path)
    vectors.add_to_collection(rows, path)
    assert sorted(r["text"] for r in vectors.scan_texts(spark, path).collect()) == ["x", "y"]
    vectors.recreate_collection(rows.limit(1), path)
    assert vectors.read_collection(spark, path).count() == 1


def test_sql_parameters(spark):
    df = spark.createDataFrame([("a'b", 1), ("c", 2)], "k string, v int")
    found = files.run_sql(spark, "SELECT v FROM small WHERE k = :key", {"small": df}, key="a'b")
    assert found.first()["v"] == 1


def test_shared_folder_is_read_from_the_session(spark):
    root = session.shared_root(spark)
    assert spark.conf.get(session.CHECKPOINT_CONF) == root
    assert session.scratch_path(spark, "x").startswith(f"{root}/mercato/x-")


def test_without_a_setting_the_warehouse_is_shared():
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}.get(key, default)

    class Cluster:
        conf = Conf()

    assert session.shared_root(Cluster()) == "hdfs://store/warehouse"


def test_a_bad_reload_leaves_the_table_alone(spark, tmp_path):
    good, bad, target = str(tmp_path / "good.csv"), str(tmp_path / "bad.csv"), str(tmp_path / "tables")
    files.write_csv(spark.createDataFrame([(1, "a")], "id int, name string"), good)
    files.write_csv(spark.createDataFrame([("x", "y")], "id string, name string"), bad)
    first = files.ingest_manifest(spark, {good: ("t", "id int, name string")}, target).first()
    second = files.ingest_manifest(spark, {bad: ("t", "id int, name string")}, target).first()
    assert (first["status"], second["status"]) == ("loaded", "failed") and second["message"]
    assert spark.read.parquet(f"{target}/t").collect() == [(1, "a")]


def test_of_equal_ids_the_least_row_is_added(spark, tmp_path):
    rows = spark.createDataFrame([("a", [2.0], "t2"), ("a", [1.0], "t1"), ("b", [0.0], "t")], "id string, embedding array<double>, text string")
    path = vectors.add_to_collection(rows, str(tmp_path / "c"))
    assert sorted((r["id"], r["text"]) for r in vectors.read_collection(spark, path).collect()) == [("a", "t1"), ("b", "t")]


def test_from_csv_to_a_mart(spark, tmp_path):
    """All eight declared tables, with their string keys, through CSV and Parquet to features and metrics."""
    shop, paths = store(spark), {}
    for name, schema in schemas.TABLES.items():
        known = {"product_category_name_translation": "translation"}.get(name, name)
        rows = getattr(shop, known, spark.createDataFrame([], schema))
        typed = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        paths[name] = files.write_csv(typed, str(tmp_path / f"{name}.csv"))
    loaded = ingest_store(spark, paths, str(tmp_path / "tables")).collect()
    assert {r["status"] for r in loaded} == {"loaded"} and len(loaded) == 8
    opened = open_store(spark, str(tmp_path / "tables"))
    for build in (delivery.delivery_features, churn.churn_profile, metrics.top_categories_revenue):
        assert sorted(map(repr, build(opened).collect())) == sorted(map(repr, build(shop).collect()))
