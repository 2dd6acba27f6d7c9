"""Similarity join of texts by a forest of MinHash tries and exact verification.

Texts are sets of runs of five words. Texts with equal words in equal order
form a class and are one node from here on. Each of 32 trees sorts the classes
by its own sequence of 8 MinHash values; in such an order, classes that share
a prefix stand together, so the common prefixes of neighbours describe the whole
trie. Matched prefixes are shortened from 8 values on, until the expected
recall of the pairs seen so far reaches the target in every band of similarity. Classes connected by
prefixes of that depth are compared exactly, all with all, in blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import discard, keep_rows, stored
from mercato.llm.components import components
from mercato.llm.shingles import sequence_key, shingles, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9999
# Width of the bands of similarity that each have the recall.
BAND = 0.05
# A block of a component has about so many words and classes; two blocks meet in a task.
BLOCK_WORDS, BLOCK_CLASSES = 200_000, 750
RUN = 1 << 18


# ---------------------------------------------------------------- signatures

def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed parameters of ``n`` hash functions of 32 bits."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, n, np.uint32), rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """16 bits of ``TREES * DEPTH`` MinHash values for every text; texts without shingles have zeros."""
    flips, factors = functions(TREES * DEPTH)
    out = np.zeros((len(begins) - 1, TREES * DEPTH), ">u2")
    some = np.flatnonzero(np.diff(begins))
    at = 0
    while at < len(some):
        # Texts of up to RUN shingles at a time stay in the processor's cache.
        end = max(at + 1, int(np.searchsorted(begins[some], begins[some[at]] + RUN)))
        rows = some[at:end]
        part = (hashes[begins[rows[0]] : begins[rows[-1] + 1]] >> np.uint64(32)).astype(np.uint32)
        starts = begins[rows] - begins[rows[0]]
        for i in range(TREES * DEPTH):
            out[rows, i] = np.minimum.reduceat(((part ^ flips[i]) * factors[i]), starts) * np.uint32(0x9E3779B1) >> np.uint32(16)
        at = end
    return out


def signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bounds = word_hashes(batch.column("text").to_pylist())
        signed = signatures(*shingles(words, bounds, WORDS))
        counts = np.diff(bounds)
        keys = [sequence_key(words[bounds[i] : bounds[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("mark"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
            pa.array([row.tobytes() for row in signed], pa.binary()),
        ], ["id", "mark", "cls", "n_words", "signature"])


# ---------------------------------------------------------------- the forest

def neighbours(least: int):
    """Edges between neighbours of a sorted partition with the length of their common prefix, ``least`` or more.

    ``path`` is the tree's number and its values. The ends of the partition come
    as rows without ``b``, to be tied to the ends of the next one.
    """

    def ends(path: bytes, cls: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([cls], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int32()), pa.array([path], pa.binary())],
            ["a", "b", "depth", "path"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, classes = batch.column("path").to_pylist(), batch.column("cls").to_pylist()
            if last is None:
                yield ends(paths[0], classes[0])
            else:
                paths, classes = [last[0], *paths], [last[1], *classes]
            raw = np.frombuffer(b"".join(paths), np.uint8).reshape(len(paths), 1 + 2 * DEPTH)
            same = raw[1:] == raw[:-1]
            pairs = same[:, 1::2] & same[:, 2::2] & same[:, :1]
            depth = np.logical_and.accumulate(pairs, axis=1).sum(axis=1)
            found = [i for i in np.flatnonzero(depth >= least).tolist() if classes[i] != classes[i + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([min(classes[i], classes[i + 1]) for i in found], pa.binary()),
                pa.array([max(classes[i], classes[i + 1]) for i in found], pa.binary()),
                pa.array([int(depth[i]) for i in found], pa.int32()), pa.nulls(len(found), pa.binary()),
            ], ["a", "b", "depth", "path"])
            last = paths[-1], classes[-1]
        if last is not None:
            yield ends(*last)

    return meet


def forest(classes: DataFrame, least: int) -> DataFrame:
    """``(a, b, depth)`` from ``(cls, signature)``: the tries' edges, with the longest prefix they were seen with.

    Prefixes shorter than ``least`` make no edge. At most one edge per class and tree. Classes with equal prefixes are
    connected by edges of at least that depth, however many there are; as the
    class is part of the order, they may spread over many partitions.
    """
    size = 2 * DEPTH
    paths = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substr(F.col("signature"), t * size + 1, F.lit(size))))
    rows = stored(classes.select("cls", F.explode(paths).alias("path")), "paths")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(spread, "path", "cls").sortWithinPartitions("path", "cls")
    seen = stored(ordered.select("path", "cls").mapInArrow(neighbours(least), "a binary, b binary, depth int, path binary"), "neighbours", rows=20_000)
    discard(rows)
    # Two rows per partition: those with a common prefix are tied to the least of them, at every depth.
    tips = seen.where("b IS NULL").select(F.col("a").alias("cls"), "path")
    deep = tips.select("cls", F.explode(F.sequence(F.lit(least), F.lit(DEPTH))).alias("depth"), "path")
    deep = deep.withColumn("path", F.expr("substring(path, 1, 1 + 2 * depth)"))
    least = deep.groupBy("path", "depth").agg(F.min("cls").alias("a"))
    tied = deep.join(least, ["path", "depth"]).where("a <> cls").select("a", F.col("cls").alias("b"), "depth")
    every = seen.where("b IS NOT NULL").select("a", "b", "depth").unionByName(tied)
    edges = stored(every.groupBy("a", "b").agg(F.max("depth").alias("depth")), "forest")
    discard(seen)
    return edges


def found_at(depth: int, similarity):
    """Probability that a pair shares a prefix of that depth in one tree at least."""
    return 1 - (1 - similarity**depth) ** TREES


def compare_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimated similarity of each pair and its longest common prefix over all trees."""
    for batch in batches:
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(batch.num_rows, TREES, DEPTH) for c in ("x", "y"))
        same = left == right
        yield pa.RecordBatch.from_arrays([
            pa.array(same.mean(axis=(1, 2)), pa.float64()),
            pa.array(np.logical_and.accumulate(same, axis=2).sum(axis=2).max(axis=1).astype(np.int32), pa.int32()),
        ], ["similarity", "depth"])


def sure_depth(similarity: float, recall: float) -> int:
    """The longest prefix that even pairs right at the threshold share often enough."""
    return max((k for k in range(1, DEPTH + 1) if found_at(k, similarity) >= recall), default=1)


def enough_depth(edges: DataFrame, classes: DataFrame, similarity: float, recall: float) -> int:
    """The longest prefix whose expected recall reaches the target in every band of similarity; never shorter than is sure.

    Of the pairs seen that are similar by their signatures, those found at a
    depth are held against all that there should be: a pair that is found with
    probability ``p`` at the least depth stands for ``1 / p`` pairs. Each band
    counts by itself: many near copies say nothing about pairs at the threshold.
    """
    sure = sure_depth(similarity, recall)
    x = classes.select(F.col("cls").alias("a"), F.col("signature").alias("x"))
    y = classes.select(F.col("cls").alias("b"), F.col("signature").alias("y"))
    pairs = stored(
        edges.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("x", "y").mapInArrow(compare_signatures, "similarity double, depth int"), "pairs")
    near = pairs.where(F.col("similarity") >= similarity)
    p = 1 - F.pow(1 - F.pow("similarity", F.lit(sure)), F.lit(TREES))
    found = [F.sum((F.col("depth") >= k).cast("double")).alias(f"d{k}") for k in range(sure, DEPTH + 1)]
    band = F.floor((F.col("similarity") - similarity) / BAND + 1e-9).alias("band")
    got = near.groupBy(band).agg(F.sum(1 / p).alias("all"), *found).collect()
    return max((k for k in range(sure, DEPTH + 1) if got and all(b[f"d{k}"] >= recall * b["all"] for b in got)), default=sure)


# ---------------------------------------------------------------- verification

def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text as 8 bytes each."""
    for batch in batches:
        found, begins = shingles(*word_hashes(batch.column("text").to_pylist()), WORDS)
        sets = [np.unique(found[begins[i] : begins[i + 1]]).tobytes() for i in range(batch.num_rows)]
        names = ["comp", "cls", "n_docs", "block", "blocks"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])


# Shingles that more texts than this share are counted by matrix products, the others pair by pair.
OFTEN = 16
COLUMNS = 512


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all pairs of sets (each without repeats)."""
    m = len(sets)
    common = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(starts, len(values)))
    for n in np.unique(counts[(counts > 1) & (counts <= OFTEN)]).tolist():
        rows = owners[starts[counts == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        np.add.at(common.reshape(-1), (rows[:, i] * m + rows[:, j]).ravel(), 1)
    often = np.flatnonzero(counts > OFTEN)
    for at in range(0, len(often), COLUMNS):
        part = often[at : at + COLUMNS]
        has = np.zeros((m, len(part)), np.float32)
        for column, run in enumerate(part.tolist()):
            has[owners[starts[run] : starts[run] + counts[run]], column] = 1
        common += has @ has.T
    return np.maximum(common, common.T)


def linked(sets: list[np.ndarray], blocks: np.ndarray, across: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` with a Jaccard similarity of ``similarity`` or more; with ``across`` only those of two blocks."""
    sizes = np.array([len(s) for s in sets], np.float64)
    common = intersections(sets)
    near = common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
    if across:
        near &= blocks[:, None] != blocks[None, :]
    return np.nonzero(np.triu(near, 1))


def spanning(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all of them connect, without circles."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def verifier(similarity: float):
    """Sorted rows of groups to ``(cls, other, docs, texts)``: links of each class in the group, and a spanning edge."""

    def send(group: list[tuple]) -> pa.RecordBatch | None:
        seen = {cls: (docs, block, found) for _, cls, docs, block, found, _ in group}
        classes = list(seen)
        if len(classes) < 2:
            return None
        weights = np.array([seen[c][0] for c in classes], np.int64)
        blocks = np.array([seen[c][1] for c in classes], np.int64)
        i, j = linked([np.frombuffer(seen[c][2], np.uint64) for c in classes], blocks, group[0][5], similarity)
        if not len(i):
            return None
        texts = np.bincount(i, minlength=len(classes)) + np.bincount(j, minlength=len(classes))
        docs = np.bincount(i, weights[j], len(classes)) + np.bincount(j, weights[i], len(classes))
        tree = spanning(zip(i.tolist(), j.tolist()), len(classes))
        hit = np.flatnonzero(texts).tolist()
        return pa.RecordBatch.from_arrays([
            pa.array([classes[k] for k in hit] + [classes[a] for a, _ in tree], pa.binary()),
            pa.array([None] * len(hit) + [classes[b] for _, b in tree], pa.binary()),
            pa.array([int(docs[k]) for k in hit] + [0] * len(tree), pa.int64()),
            pa.array([int(texts[k]) for k in hit] + [0] * len(tree), pa.int64()),
        ], ["cls", "other", "docs", "texts"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "cls", "n_docs", "block", "shingles", "across")]
            for row in zip(*columns):
                if row[0] != key and group:
                    if (out := send(group)) is not None:
                        yield out
                    group = []
                key = row[0]
                group.append(row)
        if group and (out := send(group)) is not None:
            yield out

    return verify


def verified(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """``(cls, other, docs, texts)`` of all links within components.

    ``members`` is ``(cls, comp, id, mark, n_docs, n_words)``. A large component
    is cut into blocks by a hash, every pair of blocks is a task's group, and a
    class goes to as many groups as its component has blocks. So no link is
    lost, no pair of texts leaves a task, and a group's size has a bound.
    """
    sizes = members.groupBy("comp").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("n") / BLOCK_CLASSES)).cast("int")
    sizes = stored(sizes.where("n > 1").select("comp", blocks.alias("blocks")), "sizes")
    placed = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int"))
    placed = stored(placed.select("comp", "cls", F.col("id").alias("_id"), F.col("mark").alias("_mark"), "n_docs", "block", "blocks"), "members")
    # Texts and signatures meet by one plan at any size: where few of them would be broadcast, more would be shuffled.
    texts = docs.join(placed.hint("merge"), docs["id"].eqNullSafe(placed["_id"]) & (docs["mark"] == placed["_mark"]))
    sets = stored(
        texts.select("comp", "cls", "n_docs", "block", "blocks", "text").mapInArrow(
            shingle_sets, "comp binary, cls binary, n_docs long, block int, blocks int, shingles binary"), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("*", other).select(
        "cls", "n_docs", "block", "shingles", (F.col("block") != F.col("other")).alias("across"),
        F.concat_ws("|", F.hex("comp"), F.least("block", "other"), F.greatest("block", "other")).alias("grp"))
    grouped = dealt.repartition("grp").sortWithinPartitions("grp")
    links = stored(grouped.mapInArrow(verifier(similarity), "cls binary, other binary, docs long, texts long"), "links")
    discard(sizes, placed, sets)
    return links


# ---------------------------------------------------------------- the join

def similar_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """One row per document: ``(key, class_id, n_links, n_texts, kept, mark)``.

    Documents are linked when the Jaccard similarity of their sets of five-word
    runs (A-Z in lower case) is ``similarity`` or more. ``class_id`` is the
    least key among all that links connect, directly or not; ``n_links`` counts
    the documents linked to this one, copies included, and ``n_texts`` the
    different texts among them. Of a class, the document with ``class_id`` is
    ``kept``. Texts of fewer than five words are one run; texts without words,
    NULL among them, are linked to nothing. A NULL key is above all others. If
    rows repeat key and text, one of them may be kept. Other columns are
    ignored, an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    signed = stored(asked.mapInArrow(signer, f"id {kind}, mark long, cls binary, n_words long, signature binary"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    classes = stored(
        signed.where("n_words > 0").groupBy("cls").agg(
            first, F.count(F.lit(1)).alias("n_docs"), F.first("n_words").alias("n_words"), F.first("signature").alias("signature")), "classes")
    edges = forest(classes.select("cls", "signature"), sure_depth(similarity, recall))
    depth = enough_depth(edges, classes, similarity, recall)
    comps = components(edges.where(F.col("depth") >= depth).select("a", "b"))
    members = classes.join(comps.select(F.col("node").alias("cls"), F.col("label").alias("comp")), "cls").select(
        "cls", "comp", "first.id", "first.mark", "n_docs", "n_words")
    links = verified(members, asked, similarity)
    degree = links.where("other IS NULL").groupBy("cls").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    groups = components(links.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    groups = groups.select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    known = stored(
        classes.select("cls", "first", "n_docs").join(degree, "cls", "left").join(groups, "cls", "left")
        .withColumn("grp", F.coalesce("grp", "cls")), "degrees")
    firsts = stored(known.groupBy("grp").agg(F.min("first").alias("head")), "heads")
    known = stored(
        known.join(firsts, "grp").select(
            F.col("cls").alias("_cls"), "head", (F.col("n_docs") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
            F.coalesce("texts", F.lit(0)).alias("n_texts")), "known")
    discard(classes, edges, links)
    rows = signed.select("id", "mark", "cls").join(known, F.col("cls") == F.col("_cls"), "left")
    counted = rows.groupBy("id", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.first("head").alias("head"), F.first("n_links").alias("n_links"), F.first("n_texts").alias("n_texts"))
    alone = F.col("head").isNull()
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark"))
    return counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        (alone | (is_head & (F.col("nth") == 1))).alias("kept"), "mark")


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each class."""
    return keep_rows(docs, stored(similar_texts(docs, key, text, **options).select(key, "mark", "kept"), "verdicts"), key, text)
