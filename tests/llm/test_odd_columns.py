"""Extra columns of any name and type, and rows that repeat, in every stage that keeps the table's columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import lines, periodic

NAMES = ["_v_id", "_v_mark", "_mark", "_told_id", "_told_mark", "row", "id", "mark", "a.b", "stratum", "n_words", "kept", "f", "c0", "times", "pos", "size"]


def corpus(spark, names):
    texts = [" ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60)) for i in range(30)]
    rows = [(i, t, "en", "s", 60, i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[3], (90, texts[5].upper(), "en", "s", 60, 1), (91, texts[6] + " end", None, None, 60, 2)]
    rows += [(92, None, None, None, None, None), (92, None, None, None, None, None), (None, texts[7], "en", None, 1, 7), (93, "", "en", "s", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name in names:
        docs = docs.withColumn(name, F.col("extra"))
    return docs.withColumn("tags", F.create_map(F.lit("k"), F.col("extra"))).drop("extra")


def told(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(str(root / "labels.parquet"))
    return str(root)


@pytest.mark.parametrize("nth", range(4))
def test_stages(spark, folder, nth):
    plain, odd = corpus(spark, []), corpus(spark, NAMES)
    stage = corpus_pipeline.STAGES[nth][1]
    found = stage(spark, odd, folder)
    assert found.columns == odd.columns and [t for _, t in found.dtypes] == [t for _, t in odd.dtypes]
    rows = found.collect()
    assert told(rows) == told(stage(spark, plain, folder).collect())
    for r in rows:
        assert len({r[f"{name}"] for name in NAMES}) == 1 and r["tags"] == {"k": r["row"]}


@pytest.mark.parametrize("operator", [lines.drop_shared_lines, periodic.find_periodic_runs])
def test_operators_that_carry_columns(spark, operator):
    plain, odd = corpus(spark, []), corpus(spark, NAMES)
    found = operator(odd)
    assert found.dtypes[: len(odd.columns)] == odd.dtypes
    rows = found.collect()
    assert told(rows) == told(operator(plain).collect())
    for r in rows:
        assert len({r[f"{name}"] for name in NAMES}) == 1 and r["tags"] == {"k": r["row"]}


def test_packing_reads_its_two_columns_only(spark, folder):
    stage = corpus_pipeline.STAGES[4][1]
    assert sorted(map(tuple, stage(spark, corpus(spark, NAMES), folder).collect()), key=repr) == sorted(
        map(tuple, stage(spark, corpus(spark, []), folder).collect()), key=repr)
