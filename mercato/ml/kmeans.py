"""k-means with all starts in one pass per iteration.

Coordinates are whole millionths, so sums and centers do not depend on the
order of the rows; seeds come from hashes of the keys. Every run gives the
same groups, and SQL can follow each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.sources.files import materialize, remove

UNIT, MOST_STEPS = 1e6, 300


def whole(value: Column) -> Column:
    return F.round(value * F.lit(UNIT)).cast("bigint")


def distance(coordinates: list[Column], center: Column) -> Column:
    """Squared distance, added up in the order of the coordinates."""
    total = F.lit(0.0)
    for i, x in enumerate(coordinates):
        total = total + (x - center[i]) * (x - center[i])
    return total


def nearest(coordinates: list[Column], centers: Column) -> Column:
    """``(d, cluster)`` of the nearest center; the first of equals."""
    return F.array_min(F.transform(
        centers, lambda c, i: F.struct(distance(coordinates, c).alias("d"), i.cast("int").alias("cluster"))))


def hashed(key: str, start: Column, nth: int, seed: int) -> Column:
    """A repeatable number in (0, 1) for a key, a start and a seed's number."""
    text = F.concat_ws("|", F.col(key).cast("string"), start.cast("string"), F.lit(str(nth)), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def seeds(points: DataFrame, key: str, names: list[str], clusters: int, starts: int, seed: int) -> list[list[list[float]]]:
    """First centers of every start: each next point is drawn by its squared distance from the ones before.

    The draw is a race: the least ``-ln(u) / d`` wins, which is one minimum over
    all points for all starts. Fewer different points than clusters give fewer centers.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(starts)]
    coordinates = [F.col(n) for n in names]
    for nth in range(clusters):
        known = F.lit([[]]).cast("array<array<array<double>>>") if not nth else F.lit([c or [[]] for c in chosen])
        start = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")
        at = F.lit(1.0) if not nth else nearest(coordinates, known[F.col("start")])["d"]
        raced = points.select("*", start).withColumn("d", at).where("d > 0").withColumn(
            "race", -F.ln(hashed(key, F.col("start"), nth, seed)) / F.col("d"))
        won = raced.groupBy("start").agg(F.min_by(F.array(*[c.cast("double") for c in coordinates]), F.struct("race", key)).alias("x"))
        for r in won.collect():
            chosen[r["start"]].append(list(r["x"]))
    return chosen


def step(points: DataFrame, names: list[str], centers: dict[int, list[list[float]]]) -> dict[tuple[int, int], tuple]:
    """``(start, cluster)`` to its new center and its cost, over all points and starts at once."""
    coordinates = [F.col(n) for n in names]
    options = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(c).alias("centers")) for s, c in centers.items()])
    assigned = points.select(*names, F.explode(options).alias("o")).select(*names, "o.start", nearest(coordinates, F.col("o.centers")).alias("near"))
    summed = assigned.groupBy("start", F.col("near.cluster").alias("cluster")).agg(
        *[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("near.d") / UNIT).cast("bigint")).alias("cost"))
    return {(r["start"], r["cluster"]): ([r[n] / r["n"] for n in names], r["cost"]) for r in summed.collect()}


def fit(df: DataFrame, key: str, columns: list[str], clusters: int, starts: int, seed: int = 42) -> list[list[float]]:
    """Centers of the start with the least cost, in the order of their coordinates, in millionths.

    Points without one of the coordinates are left out. Each iteration reads
    the points once, however many starts still move; only the sums per start
    and cluster pass the driver. An empty cluster keeps its center; ties go to
    the first start. A table without points has no centers.
    """
    names = [f"x{i}" for i in range(len(columns))]
    points = materialize(df.select(F.col(key).alias("key"), *[whole(F.col(c)).alias(n) for c, n in zip(columns, names)]).dropna(), "points")
    centers = {s: c for s, c in enumerate(seeds(points, "key", names, clusters, starts, seed)) if c}
    moving = dict(centers)
    for _ in range(MOST_STEPS):
        if not moving:
            break
        found = step(points, names, moving)
        after = {s: [found.get((s, i), (c,))[0] for i, c in enumerate(old)] for s, old in moving.items()}
        centers |= after
        moving = {s: c for s, c in after.items() if c != moving[s]}
    cost = {s: 0 for s in centers}
    for (s, _), (_, spent) in (step(points, names, centers) if centers else {}).items():
        cost[s] += spent
    remove(points.sparkSession, points.written_to)
    return sorted(centers[min(cost, key=lambda s: (cost[s], s))]) if cost else []
