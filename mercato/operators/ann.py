"""Approximate nearest neighbours: inverted lists of product-quantised codes.

Vectors belong to the cell of their nearest center, and a vector is kept as
one byte per part of its difference from that center. A query visits the cells
next to it, reads distances of whole cells from small tables, and only its
best few candidates are compared by their vectors. Centers and code words are
learnt from a bounded sample; every vector is indexed. Lists are cut into
blocks, so that a cell with a third of all vectors is many tasks' work.
"""

from __future__ import annotations

import dataclasses
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.sources.files import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors to learn from, cells at most, parts of a vector, code words of a part.
SAMPLE, MOST_CELLS, PARTS, WORDS = 20_000, 512, 8, 256
BLOCK_ROWS, TILE, ROUNDS = 8192, 128, 12
# Share of the cells that a query visits, and candidates per wanted neighbour that are compared by their vectors.
# Vectors without clusters need as many for a recall of 0.9; a quarter of the cells is enough where there are clusters.
VISITED, CANDIDATES = 0.75, 16


def matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors have different lengths")
    return np.array(rows)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centers."""
    squared = (points * points).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * points @ centers.T
    return np.maximum(squared, 0.0)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i : i + 4096], centers).argmin(1) for i in range(0, len(points), 4096)])


def learn_centers(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` centers (fewer where there are fewer points) of a sample that the driver holds."""
    rng = np.random.default_rng(seed)
    points = points[rng.permutation(len(points))]
    centers = points[:n].copy()
    for _ in range(ROUNDS):
        at = nearest(points, centers)
        count = np.bincount(at, minlength=len(centers))
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[filled]
        centers[filled] = np.add.reduceat(points[order], starts) / count[filled][:, None]
    return centers


@dataclasses.dataclass
class Coder:
    """Centers of the cells and code words of the parts: a few hundred KB, however large the corpus."""

    centers: np.ndarray
    edges: list[int]
    words: list[np.ndarray]

    @classmethod
    def learn(cls, sample: np.ndarray, cells: int, parts: int = PARTS, seed: int = 42) -> Coder:
        centers = learn_centers(sample, cells, seed)
        rest = sample - centers[nearest(sample, centers)]
        edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int).tolist()
        words = [learn_centers(rest[:, a:b], WORDS, seed + 1 + i) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        return cls(centers, edges, words)

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(points, self.centers)
        rest = points - self.centers[cell]
        codes = [nearest(rest[:, a:b], w) for a, b, w in zip(self.edges, self.edges[1:], self.words)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def rough(self, points: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of all points from all codes of a cell: one table per part, looked up."""
        rest, out = points - self.centers[cell], np.zeros((len(points), len(codes)))
        for i, (a, b, words) in enumerate(zip(self.edges, self.edges[1:], self.words)):
            out += distances(rest[:, a:b], words)[:, codes[:, i]]
        return out

    def visits(self, points: np.ndarray, n: int) -> np.ndarray:
        far = distances(points, self.centers)
        return np.argsort(far, 1, kind="stable")[:, :n]


@dataclasses.dataclass
class Index:
    """``lists`` has ``(cell, block, doc, code)``, ``vectors`` ``(doc, vector)``; both lie in the shared folder."""

    coder: Coder | None
    lists: DataFrame | None
    vectors: DataFrame
    blocks: dict[int, int]
    doc: str
    vector: str


def build_index(corpus: DataFrame, doc: str, vector: str = "embedding", sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> Index:
    """Index of every row with a vector; learnt from the ``sample`` rows whose ids have the least hashes."""
    kind = corpus.schema[doc].dataType.simpleString()
    known = materialize(corpus.where(F.col(vector).isNotNull()).select(doc, vector), "vectors")
    rows = known.count()
    if not rows:
        return Index(None, None, known, {}, doc, vector)
    taken = known.select(doc, vector).orderBy(F.xxhash64(doc), doc).limit(sample).toPandas()
    coder = Coder.learn(matrix(taken[vector]), min(MOST_CELLS, math.ceil(math.sqrt(rows))))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                cell, codes = coder.encode(matrix(part[vector]))
                yield pd.DataFrame({doc: part[doc], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})

    coded = materialize(known.mapInPandas(encode, f"`{doc}` {kind}, cell int, code binary"), "codes")
    sizes = {r["cell"]: -(-r["n"] // block_rows) for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.element_at(F.lit([sizes.get(c, 1) for c in range(len(coder.centers))]), F.col("cell") + 1)
    lists = coded.withColumn("block", F.pmod(F.xxhash64(doc), blocks.cast("long")).cast("int"))
    return Index(coder, lists, known, sizes, doc, vector)


def knn_approx(
    queries: DataFrame, index: Index, query_keys: list[str], k: int = 10, visited: float = VISITED, candidates: int = CANDIDATES
) -> DataFrame:
    """About the ``k`` nearest rows of the index per query, ``(*query_keys, doc, dist, rank)``; ties by ``doc``.

    ``dist`` is the exact squared distance of what was found. A query visits
    the share ``visited`` of the cells, one at least. Queries without a vector
    find nothing, and so do all queries in an empty index.
    """
    doc, vector, coder, blocks = index.doc, index.vector, index.coder, index.blocks
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *index.vectors.schema.fields]}
    keys = ", ".join(f"`{c}` {types[c]}" for c in query_keys)
    asked = materialize(queries.where(F.col(vector).isNotNull()).select(*query_keys, vector), "queries")
    if coder is None:
        return queries.sparkSession.createDataFrame([], f"{keys}, `{doc}` {types[doc]}, dist double, rank int")
    wanted, cells = k * candidates, max(1, math.ceil(len(coder.centers) * visited))

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                found = coder.visits(matrix(part[vector]), cells)
                yield part.assign(cells=[[int(c) for c in row if c in blocks] for row in found])

    visits = asked.mapInPandas(visit, f"{keys}, `{vector}` {types[vector]}, cells array<int>").select(
        *query_keys, vector, F.explode("cells").alias("cell"))
    of_cell = F.element_at(F.lit([blocks.get(c, 1) for c in range(len(coder.centers))]), F.col("cell") + 1)
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell - 1)))

    def nothing(names: list[str]) -> list:
        return [F.lit("0").cast(types[c]).alias(c) for c in names]

    sides = index.lists.select(
        "cell", "block", F.lit(0).alias("side"), doc, "code", F.array().cast(types[vector]).alias(vector), *nothing(query_keys)
    ).unionByName(visits.select("cell", "block", F.lit(1).alias("side"), *nothing([doc]), F.lit(b"").alias("code"), vector, *query_keys))
    dealt = sides.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's codes come first, then the queries that visit it, batch by batch."""
        held_key, ids, codes = None, [], []
        for part in parts:
            for key, group in part.groupby(["cell", "block"], sort=True):
                if key != held_key:
                    held_key, ids, codes = key, [], []
                own, visitors = group[group["side"] == 0], group[group["side"] == 1]
                if len(own):
                    ids.append(own[doc].to_numpy())
                    codes.append(np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1))
                if not len(visitors) or not ids:
                    continue
                ids, codes = [np.concatenate(ids)], [np.concatenate(codes)]
                points, keep = matrix(visitors[vector]), min(wanted, len(ids[0]))
                for start in range(0, len(points), TILE):
                    rough = coder.rough(points[start : start + TILE], key[0], codes[0])
                    near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
                    row = np.repeat(np.arange(start, start + len(rough)), keep)
                    yield visitors[query_keys].iloc[row].reset_index(drop=True).assign(
                        **{doc: ids[0][near.ravel()], "rough": np.take_along_axis(rough, near, 1).ravel()})

    found = dealt.mapInPandas(compare, f"{keys}, `{doc}` {types[doc]}, rough double")
    rank = F.row_number().over(Window.partitionBy(*query_keys).orderBy("rough", doc))
    best = found.withColumn("place", rank).where(F.col("place") <= wanted).select(*query_keys, doc)
    # Only now vectors meet: those of the best candidates with those of their queries.
    met = best.join(index.vectors.select(doc, F.col(vector).alias("_known")), doc).join(asked, query_keys)
    gaps = F.zip_with("_known", vector, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    exact = met.select(*query_keys, doc, F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x).alias("dist"))
    order = F.row_number().over(Window.partitionBy(*query_keys).orderBy("dist", doc))
    return exact.withColumn("rank", order).where(F.col("rank") <= k).select(*query_keys, doc, "dist", "rank")


def recall(found: DataFrame, exact: DataFrame, query_keys: list[str], doc: str) -> DataFrame:
    """``(wanted, found)``: the rows of the exact search, and how many of them were found."""
    hits = exact.select(*query_keys, doc).join(found.select(*query_keys, doc, F.lit(1).alias("hit")), [*query_keys, doc], "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
