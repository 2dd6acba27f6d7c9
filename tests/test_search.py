"""BM25 against plain Python, and the approximate search against the exact one."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.operators import ann, knn, lexical
from mercato.plans import retrieval


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def impacts(docs):
    held = {}
    for doc, text in docs:
        held.setdefault(doc, []).extend(split(text))
    held = {d: w for d, w in held.items() if w}
    n, mean = len(held), sum(map(len, held.values())) / max(1, len(held))
    df = {}
    for w in held.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for d, w in held.items():
        for t in set(w):
            tf = w.count(t)
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            out[d, t] = round(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))) * 1e9)
    return out


def ranked(query, known, k):
    total = {}
    for (doc, term), impact in known.items():
        if term in set(split(query)):
            total[doc] = total.get(doc, 0) + impact
    best = sorted(total, key=lambda d: (-total[d], d))[:k]
    return [(d, total[d]) for d in best]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    draw = lambda: pool[min(399, int(rng.paretovariate(0.6)) - 1)]
    docs = [(i, " ".join(draw() for _ in range(rng.randint(1, 60))) + " the") for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,; "), (7, "the w3 extra"), (203, "Ärger über Größe, the"), (204, "the " * 500)]
    asked = [(i, " ".join(draw() for _ in range(rng.randint(1, 9))) + rng.choice([" the", " unknown", ""])) for i in range(60)]
    return docs, asked + [(100, None), (101, "none of these"), (102, "the"), (103, "Größe the THE")]


@pytest.fixture(scope="module")
def index(spark, texts):
    return lexical.build_index(spark.createDataFrame(texts[0], "doc_id long, text string").repartition(4))


def test_postings_as_by_formula(texts, index):
    known = impacts(texts[0])
    found = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    assert found.keys() == known.keys() and all(abs(found[k] - known[k]) <= 1 for k in known)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_finds_what_scoring_every_document_finds(spark, texts, index, k):
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    asked = spark.createDataFrame(texts[1], "query_id long, query string").repartition(3)
    found = {}
    for r in lexical.search(asked, index, k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for key, query in texts[1]:
        assert found.get(key, []) == [(d, s / 1e9) for d, s in ranked(query, known, k)], query


def test_frequent_terms_are_met_alike(spark, texts, index, monkeypatch):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    for share in (0.0, 1.0):
        monkeypatch.setattr(lexical, "FREQUENT", share)
        other = lexical.build_index(docs)
        assert sorted(other.postings.collect()) == sorted(index.postings.collect())


def test_candidates_and_feedback(spark, texts, index):
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    asked = spark.createDataFrame(texts[1], "query_id long, query string")
    pairs = spark.createDataFrame([(q, d, 0) for q in (0, 1, 102) for d in (3, 7, 200, 204)], "query_id long, doc_id long, seen int")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25_scores(pairs, asked, index).collect()}
    by_id = dict(texts[1])
    assert found == {
        (q, d): sum(known.get((d, t), 0) for t in set(split(by_id[q]))) / 1e9 for q in (0, 1, 102) for d in (3, 7, 200, 204)}
    variants = {(r["query_id"], r["variant"]): r["query"] for r in lexical.feedback_variants(asked, index, 3, 4).collect()}
    for key, query in texts[1]:
        weight = {}
        for doc, _ in ranked(query, known, 3):
            for (d, t), impact in known.items():
                if d == doc and t not in set(split(query)):
                    weight[t] = weight.get(t, 0) + impact
        added = " ".join(sorted(weight, key=lambda t: (-weight[t], t))[:4])
        assert variants[key, 0] == query
        assert variants.get((key, 2)) == (added or None)
        assert variants.get((key, 1)) == (f"{query} {added}" if added else None)


def test_empty_tables(spark):
    none = lexical.build_index(spark.createDataFrame([], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert lexical.search(asked, none, 3).collect() == []
    assert [r["variant"] for r in lexical.feedback_variants(asked, none).collect()] == [0]


def clouds(n, dims, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims)) * 3
    return middle[rng.integers(0, 12, n)] + rng.normal(size=(n, dims))


def found_share(spark, points, k=10, visited=ann.VISITED, **options):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(4)
    asked = corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    index = ann.build_index(corpus, "doc_id", **options)
    assert index.lists.count() == len(rows)
    found = ann.knn_approx(asked, index, ["query_id"], k, visited)
    exact = knn.knn_topk(asked, corpus, ["query_id"], "doc_id", k)
    told = ann.recall(found, exact, ["query_id"], "doc_id").first()
    for r in found.limit(40).collect():
        assert r["dist"] == pytest.approx(float(((np.float32(points[r["query_id"]]).astype(float) - np.float32(points[r["doc_id"]])) ** 2).sum()), abs=1e-9)
    assert found.groupBy("query_id").agg(F.max("rank").alias("r")).where(F.col("r") != min(k, len(rows))).isEmpty()
    return told["found"] / told["wanted"]


@pytest.mark.parametrize("points", [clouds(3000, 64, 1), clouds(2000, 10, 2)])
def test_neighbours_in_clusters_are_found_in_a_quarter_of_the_cells(spark, points):
    assert found_share(spark, points, visited=0.25) >= 0.9


def test_neighbours_without_any_clusters(spark):
    assert found_share(spark, np.random.default_rng(3).normal(size=(1500, 32))) >= 0.9


def test_a_hot_cell_is_cut_into_blocks(spark):
    points = np.concatenate([clouds(1000, 8, 4), np.repeat(clouds(1, 8, 5), 500, 0) + np.arange(500)[:, None] * 1e-4])
    assert found_share(spark, points, block_rows=60) >= 0.9


def test_recall_on_the_supplied_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
        assert found_share(spark, np.array([r["embedding"] for r in rows])) >= 0.9


def test_odd_vectors(spark):
    schema = "doc_id long, embedding array<float>"
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], schema).withColumnRenamed("doc_id", "query_id")
    none = ann.build_index(spark.createDataFrame([(5, None)], schema), "doc_id")
    assert ann.knn_approx(asked, none, ["query_id"]).collect() == []
    few = ann.build_index(spark.createDataFrame([(7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, None), (10, [4.0, 6.0])], schema), "doc_id")
    found = [tuple(r) for r in ann.knn_approx(asked, few, ["query_id"], 2, visited=1.0).orderBy("rank").collect()]
    assert found == [(1, 7, 0.0, 1), (1, 8, 0.0, 2)]


def test_blocks_and_parts_of_any_size_give_the_same(spark, texts, index, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(lexical, "PART_VISITS", 20)
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    asked = spark.createDataFrame(texts[1], "query_id long, query string").repartition(3)
    found = {}
    for r in lexical.search(asked, index, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for key, query in texts[1]:
        assert found.get(key, []) == [(d, s / 1e9) for d, s in ranked(query, known, 5)], query


def test_texts_of_one_file_are_taken_apart_by_all_tasks_and_once(spark, monkeypatch):
    texts = [(i, None if i == 7 else f"Alpha beta{i % 5} gamma{i % 3}, alpha") for i in range(40)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    queries = corpus.withColumnsRenamed({"doc_id": "query_id", "text": "query"})
    pairs = [(q, (q * k) % 20) for q in range(20) for k in (1, 3, 7)]
    candidates = spark.createDataFrame(sorted(set(pairs)), "query_id long, doc_id long")
    written = []

    def watched(df, purpose, f=retrieval.materialize):
        out = f(df, purpose)
        written.append((purpose, df.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(retrieval, "materialize", watched)
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.lexical_scores(candidates, queries, corpus).collect()}
    words = {i: set(re.findall(r"\w+", t.lower())) if t else set() for i, t in texts}
    assert found == {(q, d): len(words[q] & words[d]) * 10 // len(words[q]) if words[q] else 0 for q, d in pairs}
    assert [(p, n) for p, _, n in written] == [("candidates", len(set(pairs))), ("words", 20), ("words", 20)]
    assert all(n >= spark.sparkContext.defaultParallelism for p, n, _ in written if p == "words")


def test_words_of_a_query_go_to_its_candidates_as_one_string(spark, monkeypatch):
    texts = ["Alpha beta, GAMMA beta", None, "", "... -- !", "beta delta\tepsilon", "été naïve 42 4 2", "alpha"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = spark.createDataFrame([(a, b, b) for a in range(7) for b in range(7)], "query_id int, doc_id int, seen int")
    kinds = {}

    def watched(*a, f=retrieval._word_lists, **more):
        out = f(*a, **more)
        kinds[a[3]] = dict(out.dtypes)[a[3]]
        return out

    monkeypatch.setattr(retrieval, "_word_lists", watched)
    found = retrieval.lexical_scores(pairs, rows.toDF("query_id", "query"), rows).collect()
    words = [{w for w in re.split(r"[\W_]+", (t or "").lower()) if w} for t in texts]
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in found} == {
        (a, b): len(words[a] & words[b]) * 10 // len(words[a]) if words[a] else 0 for a in range(7) for b in range(7)}
    assert kinds == {"_asked": "string", "_words": "array<string>"}


def exchanged(df):
    """What the plan's shuffles deal rows by, without the numbers of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?|, \d+$", "", found) for found in re.findall(r"Exchange (.*?), (?:ENSURE|REPARTITION)", plan)]


def written(monkeypatch):
    found = {}

    def watched(df, purpose, f=lexical.materialize):
        out = f(df, purpose)
        found[purpose] = out.count()
        return out

    monkeypatch.setattr(lexical, "materialize", watched)
    return found


def in_blocks(spark, texts, monkeypatch, postings=300):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    odd = [(None, "the w3 w5"), (-5, "w3 w5 the"), (7, "w9"), (300, " ")]
    docs = texts[0] + odd
    return [d for d in docs if d[0] is not None], lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))


def test_an_index_is_blocks_and_no_posting_is_a_row_on_its_way(spark, texts, monkeypatch):
    rows = written(monkeypatch)
    docs, index = in_blocks(spark, texts, monkeypatch)
    assert index.count > 5 and rows == {"packed": index.count, "postings": index.count}
    found = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    known = impacts(docs + [(None, "the w3 w5")])
    assert found.keys() == known.keys() and all(abs(found[k] - known[k]) <= 1 for k in known)
    told = {r["term"]: (r["df"], r["top"]) for r in index.terms.collect()}
    assert told["w3"] == (sum(t == "w3" for _, t in found), max(v for (_, t), v in found.items() if t == "w3"))


def test_feedback_sends_the_terms_of_a_hit_as_one_row(spark, texts, monkeypatch):
    """Terms of hits are added up in parts of the queries, of any size; the shuffles deal blocks and parts, never terms."""
    _, index = in_blocks(spark, texts, monkeypatch)
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    asked = spark.createDataFrame(texts[1], "query_id long, query string")
    by_id = dict(texts[1])
    hits = spark.createDataFrame([(q, d) for q, _ in texts[1][:30] for d in (q, q + 7, 7, 204, 999)] + [(3, 7)], "query_id long, doc_id long")
    for size in (4, 1 << 12):
        monkeypatch.setattr(lexical, "PART_QUERIES", size)
        found = lexical.feedback_terms(hits, asked, index, 4)
        assert exchanged(found) and not any("term" in keys for keys in exchanged(found))
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], []).append((r["place"], r["term"], r["weight"]))
        for q, _ in texts[1][:30]:
            weight = {}
            for doc in (q, q + 7, 7, 204, *([7] if q == 3 else [])):
                for (d, t), impact in known.items():
                    if d == doc and t not in set(split(by_id[q])):
                        weight[t] = weight.get(t, 0) + impact
            best = sorted(weight, key=lambda t: (-weight[t], t))[:4]
            assert sorted(got.get(q, [])) == [(i, t, weight[t] / 1e9) for i, t in enumerate(best, 1)]


@pytest.mark.parametrize("visits", [7, 1 << 16])
def test_a_search_writes_no_copies_of_blocks_or_queries(spark, texts, monkeypatch, visits):
    """More blocks and parts than tasks: a shuffle takes the best of each query in a group of blocks, and nothing else."""
    docs, index = in_blocks(spark, texts, monkeypatch, 60)
    monkeypatch.setattr(lexical, "PART_VISITS", visits)
    assert index.count > 2 * spark.sparkContext.defaultParallelism
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    asked = spark.createDataFrame(texts[1], "query_id long, query string").repartition(3)
    best = lexical.search(asked, index, 5)
    assert {re.sub(r",.*", "", keys) for keys in exchanged(best)} == {"hashpartitioning(query"}
    found = {}
    for r in best.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    # NULL comes first among equals, as in SQL here.
    first = sorted({d for d, _ in known}, key=lambda d: (d is not None, d or 0))
    place = {d: i for i, d in enumerate(first)}
    for key, query in texts[1]:
        plain = ranked(query, {(place[d], t): v for (d, t), v in known.items()}, 5)
        assert found.get(key, []) == [(first[d], s / 1e9) for d, s in plain], query


def test_words_of_a_question_go_to_a_block_as_one_string(spark, texts, monkeypatch):
    _, index = in_blocks(spark, texts, monkeypatch)
    known = {(r["doc"], r["term"]): r["impact"] for r in index.postings.collect()}
    sent = []
    monkeypatch.setattr(lexical, "_meet", lambda index, visits, *rest, f=lexical._meet: sent.append((dict(visits.dtypes), visits.count())) or f(index, visits, *rest))
    asked = spark.createDataFrame(texts[1], "query_id long, query string")
    pairs = [(q, d) for q in (0, 1, 100, 101, 102, 103) for d in (3, 7, 200, 203, 204, 999)]
    for visits in (2, 1 << 16):
        monkeypatch.setattr(lexical, "PART_VISITS", visits)
        found = lexical.bm25_scores(spark.createDataFrame(pairs, "query_id long, doc_id long"), asked, index)
        by_id = dict(texts[1])
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()} == {
            (q, d): sum(known.get((d, t), 0) for t in set(split(by_id[q]))) / 1e9 for q, d in pairs}
        assert not any("term" in keys for keys in exchanged(found))
    assert all(kinds["words"] == "string" and n <= len(pairs) for kinds, n in sent)
