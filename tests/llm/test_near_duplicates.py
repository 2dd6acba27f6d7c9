"""The join against all pairs, and its parts against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from mercato.llm import components, shingles
from mercato.llm import near_duplicates as op

SCHEMA = "doc_id long, text string, source string, cls string, Mark int"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w]


def runs(words):
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, similarity=0.8):
    sets = [(key, words_of(text)) for key, text, *_ in rows]
    sets = [(key, words, runs(words)) for key, words in sets]
    n, parent = len(sets), list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, texts = defaultdict(int), defaultdict(set)
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a[2] and b[2] and len(a[2] & b[2]) >= similarity * len(a[2] | b[2]) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
                for x, y in ((i, j), (j, i)):
                    links[x] += 1
                    if sets[x][1] != sets[y][1]:
                        texts[x].add(tuple(sets[y][1]))
    heads = defaultdict(list)
    for i in range(n):
        heads[root(i)].append(sets[i][0])
    least = {r: min(keys, key=lambda k: (k is None, k or 0)) for r, keys in heads.items()}
    return sorted(((sets[i][0], least[root(i)], links[i], len(texts[i])) for i in range(n)), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["of", "the"]) if rng.random() < 0.2 else f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 30, 80, 200]))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    hot = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    made = [" ".join(t) for t in texts] + ["", None, " \n ", "one", "One", "one two", "A b C d E", "a  b\tc d e"] + [" ".join(hot)] * 5
    rows = [(i, t, "s", "c", 1) for i, t in enumerate(made)]
    rng.shuffle(rows)
    return rows + [(3, rows[0][1], "x", None, None), (None, made[0], None, None, None), (None, None, None, None, None), (7, None, "", "", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_classes(spark, seed, monkeypatch):
    if seed == 2:
        # The hot group in many blocks.
        monkeypatch.setattr(op, "BLOCK_CLASSES", 9)
    rows = corpus(seed)
    found = op.similar_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in found), key=repr) == brute(rows)


def test_empty_blocks_count_nothing_twice(spark, monkeypatch):
    # Three or four texts in as many blocks or more: some blocks are empty.
    monkeypatch.setattr(op, "BLOCK_WORDS", 60)
    rng = random.Random(4)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(rng.randint(2, 4)):
            rows.append((len(rows), " ".join([*base[:k], "x", *base[k + 1:]]), "", "", 0))
    found = op.similar_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in found), key=repr) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(3, 20)
    rows += [rows[0], rows[0], rows[1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = op.drop_similar(docs)
    assert left.schema.simpleString() == docs.schema.simpleString()
    wordless = sorted((r[0] for r in rows if not words_of(r[1])), key=repr)
    heads = {c for k, c, *_ in brute([r for r in rows if words_of(r[1])])}
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([*heads, *wordless], key=repr)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.similar_texts(docs).count() == 0 and op.drop_similar(docs).count() == 0
    blank = spark.createDataFrame([(1, "", "", "", 0), (2, None, "", "", 0)], SCHEMA)
    assert sorted((r["class_id"], r["n_links"]) for r in op.similar_texts(blank).collect()) == [(1, 0), (2, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_common_parts(seed, monkeypatch):
    monkeypatch.setattr(op, "OFTEN", 3)
    monkeypatch.setattr(op, "COLUMNS", 7)
    rng = random.Random(seed)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(rng.randint(2, 30))]
    found = op.intersections([np.array(s, np.uint64) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(set(a) & set(b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = int(1000 * share)
        a, b = np.concatenate([base[:n], base[1000:1000 + (1000 - n) // 2]]), np.concatenate([base[:n], base[2000:2000 + 1000 - n - (1000 - n) // 2]])
        sig = op.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((sig[0] == sig[1]).mean() - n / 1000) < 0.1


def test_expected_recall():
    assert op.found_at(6, 0.8) > 0.9999 > op.found_at(7, 0.8)
    assert (op.sure_depth(0.8, 0.9999), op.sure_depth(0.5, 0.999), op.sure_depth(0.95, 0.99)) == (6, 2, 8)


def test_near_copies_do_not_hide_pairs_at_the_threshold(spark):
    size = op.TREES * op.DEPTH
    one = np.arange(size, dtype=">u2")
    # Similar by 0.82 and with no common prefix of 7 in any tree, though of 6 in most.
    two = one.reshape(op.TREES, op.DEPTH).copy()
    two[:, 6] += 5000
    two[:14, 7] += 5000
    classes = spark.createDataFrame([(b"a", one.tobytes()), (b"b", one.tobytes()), (b"c", two.tobytes())], "cls binary, signature binary")
    copies = spark.range(30000).selectExpr("cast('a' AS binary) AS a", "cast('b' AS binary) AS b", "8 AS depth")
    pair = spark.createDataFrame([(b"a", b"c", 6)], "a binary, b binary, depth int")
    assert op.enough_depth(copies, classes, 0.8, 0.9999) == 8
    assert op.enough_depth(copies.unionByName(pair), classes, 0.8, 0.9999) == 6


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(300, x) for x in range(301, 340)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rng.shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_word_hashes_in_blocks(monkeypatch):
    rng = random.Random(9)
    texts = [None, "", " a", "É é\tÉ", "A a"] + [" ".join("xyzäß"[: rng.randint(1, 5)] * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    whole, bounds = shingles.word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(words_of(t)) for t in texts]
    names = {}
    for i, t in enumerate(texts):
        for w, h in zip(words_of(t), whole[bounds[i]:bounds[i + 1]].tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(shingles, "BLOCK", 50)
    again, same = shingles.word_hashes(texts)
    assert (again == whole).all() and (same == bounds).all()


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = entry.queries()["op7_lsh_forest_join"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in found), key=repr) == brute(rows)
