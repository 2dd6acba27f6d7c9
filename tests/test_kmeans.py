"""All starts at once against one start after the other in plain Python."""

import hashlib
import math
import random

import pytest

from mercato.ml import kmeans


def dist(a, b):
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), 0.0)


def near(p, centers):
    return min(range(len(centers)), key=lambda i: (dist(p, centers[i]), i))


def plain(points, clusters, starts, seed=42):
    found = []
    for s in range(starts):
        centers = []
        for nth in range(clusters):
            raced = []
            for key, p in points.items():
                d = 1.0 if not nth else min(dist(p, c) for c in centers)
                if d > 0:
                    u = (int(hashlib.md5(f"{key}|{s}|{nth}|{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
                    raced.append((-math.log(u) / d, key))
            if raced:
                centers.append([float(x) for x in points[min(raced)[1]]])
        for _ in range(kmeans.MOST_STEPS):
            groups = [[] for _ in centers]
            for p in points.values():
                groups[near(p, centers)].append(p)
            after = [[sum(x) / len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centers)]
            if after == centers:
                break
            centers = after
        cost = sum(round(dist(p, centers[near(p, centers)]) / 1e6) for p in points.values())
        found.append((cost, s, centers))
    return sorted(min(found)[2])


@pytest.mark.parametrize("clusters, starts", [(3, 6), (1, 2), (5, 3)])
def test_centers_as_by_plain_steps(spark, clusters, starts):
    rng = random.Random(clusters)
    rows = [(f"k{i}", rng.gauss(i % 4, 0.4), rng.gauss(-(i % 3), 0.4)) for i in range(150)]
    df = spark.createDataFrame([*rows, ("none", None, 1.0)], "key string, a double, `b.c` double").repartition(4)
    renamed = df.withColumnRenamed("b.c", "b")
    points = {k: [math.floor(abs(v) * 1e6 + 0.5) * (1 if v > 0 else -1) for v in (a, b)] for k, a, b in rows}
    assert kmeans.fit(renamed, "key", ["a", "b"], clusters, starts) == plain(points, clusters, starts)


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "key string, x double")
    assert kmeans.fit(df, "key", ["x"], 3, 4) == [[1e6], [2e6]]
    assert kmeans.fit(df.where("false"), "key", ["x"], 3, 4) == []


def test_one_pass_an_iteration_whatever_the_starts(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * i % 37)) for i in range(60)], "key long, x double")
    taken = []
    step = kmeans.step
    monkeypatch.setattr(kmeans, "step", lambda points, names, centers: taken.append(len(centers)) or step(points, names, centers))
    kmeans.fit(df, "key", ["x"], 3, 8)
    assert taken[0] == 8 and taken == sorted(taken[:-1], reverse=True) + [8]
