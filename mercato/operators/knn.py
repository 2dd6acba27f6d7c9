"""Exact nearest neighbours by squared Euclidean distance, for any number of queries.

Corpus vectors belong to the cell of their nearest pivot; cells are cut into
blocks of limited size, and neighbouring blocks make up groups. A sample bounds
how far a query's ``k``-th neighbour can be, and the query goes only to groups
with a cell that the triangle inequality does not rule out. A task holds one
group while one part of the queries streams by: both are bounded, so more rows
mean more tasks, not longer ones. Within a task the bound shrinks from block to
block; vectors beyond it are ruled out by one matrix product and a comparison.
Tasks send on the best ``k`` rows per query and group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.sources.files import materialize

# The functions below travel with the tasks: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a block; blocks of a group; queries of a part, in blocks; queries and pairs that are compared at once.
BLOCK_ROWS = 8192
GROUP_BLOCKS = PART_BLOCKS = 4
TILE, PAIRS = 256, 1 << 16
# Values of the sample that bounds distances.
SAMPLE_VALUES = 1 << 19


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors have different lengths")
    values = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan"))
    return values.to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class Rough:
    """Squared distances to fixed points in single precision, as one matrix product, and how far they can be off.

    The points are taken from their middle and in units of their spread, so neither counts.
    """

    def __init__(self, points: np.ndarray):
        middle = points.mean(axis=0)
        self.middle = np.where(np.isfinite(middle), middle, 0.0)
        own = points - self.middle
        largest = float(np.nanmax((own * own).sum(axis=1), initial=0.0))
        self.unit = largest if 0 < largest < np.inf else 1.0
        own = own / math.sqrt(self.unit)
        with np.errstate(all="ignore"):
            self.turned = np.ascontiguousarray(np.concatenate([-2.0 * own, (own * own).sum(axis=1)[:, None]], axis=1).T.astype(np.float32))

    def less_own(self, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In ``unit``, per row: distances less the row's own norm, that norm, and the error."""
        own = (tile - self.middle) / math.sqrt(self.unit)
        norms = (own * own).sum(axis=1)
        with np.errstate(all="ignore"):
            far = np.concatenate([own, np.ones((len(own), 1))], axis=1).astype(np.float32) @ self.turned
        # Beyond single precision nothing is ruled out.
        return far, norms, np.where(norms < 1e30, (own.shape[1] + 8) * 2.4e-7 * (norms + 1.0), np.inf)


class Group:
    """The corpus vectors of one task, block by block."""

    def __init__(self, rows: pa.Table, doc: str, vector: str, k: int):
        self.ids = rows.column(doc)
        place = pc.rank(self.ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64)
        points = _matrix(rows.column(vector))
        # Of equal vectors only the first k by id can be among the nearest, as ties go by id.
        equal = np.unique(np.ascontiguousarray(points).view(np.dtype((np.void, max(1, 8 * points.shape[1])))).ravel(), return_inverse=True)[1]
        order = np.lexsort((place, equal))
        first = np.concatenate([[True], np.diff(equal[order]) > 0])[: len(order)]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        cell, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("cell", "block"))
        kept = order[nth < k]
        kept = kept[np.lexsort((block[kept], cell[kept]))]
        self.kept, self.place, self.points = kept, place[kept], points[kept]
        at = np.stack([cell[kept], block[kept]])
        cuts = np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1
        self.blocks = [
            (int(at[0, part[0]]), part[0], self.points[part], Rough(self.points[part]))
            for part in np.split(np.arange(len(kept)), cuts) if len(part)]

    def best(self, tile: np.ndarray, limit: np.ndarray, possible: np.ndarray, k: int):
        """Rows of the tile, places in the group and distances of the best ``k`` within ``limit``, by (distance, id)."""
        rows, docs, dists = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = limit.copy()
        for cell, start, points, rough in self.blocks:
            visit = np.flatnonzero(possible[:, cell])
            if not len(visit):
                continue
            far, norms, error = rough.less_own(tile[visit])
            within = 1.000001 * limit[visit] / rough.unit - norms + error
            # What is no number is kept, and compared exactly.
            with np.errstate(over="ignore"):
                hit, near = np.divmod(np.flatnonzero(~(far > within[:, None].astype(np.float32))), len(points))
            if not len(hit):
                continue
            hit = visit[hit]
            exact = np.concatenate([
                ((points[near[i:i + PAIRS]] - tile[hit[i:i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(hit), PAIRS)])
            rows, docs, dists = np.concatenate([rows, hit]), np.concatenate([docs, start + near]), np.concatenate([dists, exact])
            order = np.lexsort((self.place[docs], dists, rows))
            rows, docs, dists = rows[order], docs[order], dists[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = nth < k
            last = nth == k - 1
            limit[rows[last]] = np.fmin(limit[rows[last]], dists[last])
            rows, docs, dists = rows[kept], docs[kept], dists[kept]
        return rows, docs, dists


class Cells:
    """Pivots with the radius of the cell of each, groups of cells, and the sample: nothing that grows with the rows."""

    def __init__(self, centers: np.ndarray, sample: np.ndarray):
        middle = sample.mean(axis=0) if len(sample) else np.zeros(centers.shape[1])
        self.middle = np.where(np.isfinite(middle), middle, 0.0)
        self.centers, self.sample = centers - self.middle, sample
        self.largest = np.sqrt(np.nanmax((self.centers * self.centers).sum(axis=1), initial=0.0))
        self.radius = np.zeros(0)
        self.groups: list[np.ndarray] = []

    def distances(self, points: np.ndarray) -> np.ndarray:
        points = points - self.middle
        squared = (points * points).sum(axis=1)[:, None] + (self.centers * self.centers).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(squared - 2.0 * points @ self.centers.T, 0.0))

    def bounds(self, points: np.ndarray, k: int) -> np.ndarray:
        """At most so far away is the ``k``-th neighbour, squared."""
        out = np.full(len(points), np.inf)
        if len(self.sample) >= k:
            rough = Rough(self.sample)
            for start in range(0, len(points), TILE):
                far, norms, error = rough.less_own(points[start:start + TILE])
                out[start:start + TILE] = rough.unit * np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1] + norms + 2 * error, 0.0)
        return np.where(np.isnan(out), np.inf, out)

    def possible(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per point and cell: whether the cell may hold a vector within the bound."""
        limit = np.sqrt(bounds)
        # The distances come from a product of matrices, so they are off by a share of the lengths.
        own = np.sqrt(((points - self.middle) ** 2).sum(axis=1))
        limit = limit + 1e-6 * (np.where(np.isinf(limit), 0, limit) + own + self.largest)
        return ~(self.distances(points) - self.radius[None, :] > limit[:, None])


def _keep_best(candidates: DataFrame, query_keys: list[str], doc: str, k: int) -> DataFrame:
    order = Window.partitionBy(*query_keys).orderBy("dist", doc)
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*query_keys, doc, "dist", "rank")
    )


def _tiles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, TILE):
        yield batch.slice(start, TILE)


def knn_topk(
    queries: DataFrame, corpus: DataFrame, query_keys: list[str], doc: str,
    k: int = 5, vector: str = "embedding", pivots: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest corpus rows per query; ties by ``doc``.

    Rows ``(*query_keys, doc, dist, rank)``. Rows without a vector take no part;
    vectors of different lengths are an error. Both sides are written to the
    shared folder once, so what computes the vectors runs once.
    """
    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields + corpus.schema.fields}
    asked = materialize(queries.where(F.col(vector).isNotNull()).select(*query_keys, vector), "queries")
    known = materialize(corpus.where(F.col(vector).isNotNull()).select(doc, vector), "vectors")
    rows = known.count()
    if pivots is None:
        # Smaller cells than a block would only add visits: a block is one matrix product.
        pivots = min(math.ceil(math.sqrt(rows)), math.ceil(rows / block_rows))
    pivots = max(1, pivots)
    wide = len((known.select(vector).first() or [[]])[0])
    wanted = max(pivots, min(8 * math.ceil(math.sqrt(rows)), BLOCK_ROWS, SAMPLE_VALUES // max(1, wide)))
    first = known.select(vector).orderBy(F.xxhash64(doc), doc).limit(wanted).toArrow()
    sample = _matrix(first.column(vector)) if first.num_rows else np.zeros((1, 1))
    cells = Cells(sample[:pivots], sample if first.num_rows else sample[:0])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in _tiles(batch):
                far = cells.distances(_matrix(tile.column(vector)))
                # What is no number belongs to a cell that reaches everywhere.
                radius = np.where(np.isnan(far).any(axis=1), np.inf, far.min(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*tile.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(radius)], [doc, vector, "cell", "radius"])

    doc_columns = f"`{doc}` {types[doc]}, `{vector}` {types[vector]}"
    placed = materialize(known.mapInArrow(to_cells, f"{doc_columns}, cell int, radius double"), "placed")
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).orderBy("cell").collect()
    cells.radius = np.full(len(cells.centers), -np.inf)
    dealt, room, members = [], 0, []
    for cell, n, radius in counted:
        cells.radius[cell] = radius
        blocks = -(-n // block_rows)
        for block in range(blocks):
            if room < n / blocks:
                members.append([])
                room = GROUP_BLOCKS * block_rows
            room -= n / blocks
            members[-1].append(cell)
            dealt.append((cell, blocks, block, len(members) - 1))
    cells.groups = [np.unique(m) for m in members]
    if not dealt:
        dealt = [(-1, 1, 0, 0)]
    # Every task has one group of the corpus and one part of the queries.
    parts = max(1, math.ceil(asked.count() / (PART_BLOCKS * block_rows)))
    tasks = max(1, len(members)) * parts
    units = F.broadcast(placed.sparkSession.createDataFrame(dealt, "cell int, blocks int, block int, grp int"))
    blocks = units.select("cell", "blocks").distinct()
    blocked = placed.drop("radius").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(doc), F.col("blocks")).cast("int"))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = blocked.join(units.select("cell", "block", "grp"), ["cell", "block"]).select(
        "cell", "block", doc, vector, "grp", every_part.alias("part"))

    key_types = ", ".join(f"`{c}` {types[c]}" for c in query_keys)

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in _tiles(batch):
                points = _matrix(tile.column(vector))
                if not cells.groups or points.shape[1] != cells.centers.shape[1]:
                    if cells.groups:
                        raise ValueError("vectors have different lengths")
                    continue
                bounds = cells.bounds(points, k)
                possible = cells.possible(points, bounds)
                row, grp = np.nonzero(np.stack([possible[:, g].any(axis=1) for g in cells.groups], axis=1))
                sent = tile.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*sent.columns, pa.array(bounds[row]), pa.array(grp.astype(np.int32))], [*query_keys, vector, "bound", "grp"])

    part = F.pmod(F.xxhash64(*query_keys), F.lit(parts)).cast("int").alias("part")
    visits = asked.mapInArrow(to_groups, f"{key_types}, `{vector}` {types[vector]}, bound double, grp int").select("*", part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's vectors come first, then the queries that visit it, batch by batch."""
        at, held, group = None, [], None
        for batch in batches:
            task, side = (batch.column(c).to_numpy() for c in ("task", "side"))
            cuts = np.flatnonzero(np.diff(task * 2 + side)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(task)]):
                if start == end:
                    continue
                run = batch.slice(start, end - start)
                if task[start] != at:
                    at, held, group = task[start], [], None
                if side[start] == 0:
                    held.append(run.select(["cell", "block", doc, vector]))
                    continue
                if held:
                    group, held = Group(pa.Table.from_batches(held), doc, vector, k), []
                if group is None:
                    continue
                for tile in _tiles(run):
                    points, limit = _matrix(tile.column(vector)), tile.column("bound").to_numpy()
                    near, docs, dists = group.best(points, limit, cells.possible(points, limit), k)
                    found = group.ids.take(pa.array(group.kept[docs])).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [*tile.select(query_keys).take(pa.array(near)).columns, found, pa.array(dists)], [*query_keys, doc, "dist"])

    def filled(names: list[str]):
        return [F.lit(None).cast(types.get(c, "double")).alias(c) for c in names]

    task = (F.col("grp") * F.lit(parts) + F.col("part")).alias("task")
    none = F.lit(None).cast("int")
    sides = own.select(task, F.lit(0).alias("side"), "cell", "block", doc, vector, F.lit(None).cast("double").alias("bound"), *filled(query_keys)).unionByName(
        visits.select(task, F.lit(1).alias("side"), none.alias("cell"), none.alias("block"), *filled([doc]), vector, "bound", *query_keys))
    met = sides.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "side")
    return _keep_best(met.mapInArrow(compare, f"{key_types}, `{doc}` {types[doc]}, dist double"), query_keys, doc, k)
