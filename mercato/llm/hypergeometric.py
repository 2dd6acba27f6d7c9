"""Hypergeometric draws and splitting trees as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import bind, stored, uniform


def ln_factorial(x: Column) -> Column:
    """ln x! for whole x >= 0: a product up to 20, Stirling's series with an error below 1e-13 beyond."""
    y = F.greatest(x.cast("double"), F.lit(1.0))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    large = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(large)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def draw(good: Column, bad: Column, take: Column, u: Column) -> Column:
    """How many of ``take`` draws without replacement are good; ``u`` is uniform in [0, 1).

    Inverts the distribution from its mode outwards, so that the number of
    steps follows the standard deviation. 12 of these to either side leave out
    less than a double can tell from zero.
    """
    given = F.struct(
        good.cast("double").alias("g"), bad.cast("double").alias("b"), take.cast("double").alias("t"), u.alias("u"))

    def walk(c: Column) -> Column:
        g, b, t, total = c["g"], c["b"], c["t"], c["g"] + c["b"]
        low, high = F.greatest(F.lit(0.0), t - b), F.least(g, t)
        mode = F.greatest(low, F.least(high, F.floor((t + 1) * (g + 1) / (total + 2)).cast("double")))
        spread = F.sqrt(t * (g / F.greatest(total, F.lit(1.0))) * (b / F.greatest(total, F.lit(1.0)))
                        * (total - t) / F.greatest(total - 1, F.lit(1.0)))
        reach = F.least(high - low, F.ceil(12 * spread).cast("double") + 30)
        peak = F.exp(ln_choose(g, mode) + ln_choose(b, t - mode) - ln_choose(total, t))
        start = F.struct(
            g.alias("g"), b.alias("b"), t.alias("t"), mode.alias("mode"), reach.alias("reach"),
            (c["u"] - peak).alias("left"), peak.alias("up"), peak.alias("down"),
            F.when(c["u"] < peak, mode).otherwise(F.lit(None).cast("double")).alias("found"))
        return bind(start, steps)

    def steps(s: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), s["reach"].cast("int"))), s, step, finish)

    def step(s: Column, i: Column) -> Column:
        g, b, t = s["g"], s["b"], s["t"]
        x, y = s["mode"] + i, s["mode"] - i
        up = F.when((x > g) | (x > t), 0.0).otherwise(
            s["up"] * (g - x + 1) * (t - x + 1) / (x * F.greatest(b - t + x, F.lit(1.0))))
        down = F.when((y < 0) | (y < t - b), 0.0).otherwise(
            s["down"] * (y + 1) * (b - t + y + 1) / (F.greatest(g - y, F.lit(1.0)) * F.greatest(t - y, F.lit(1.0))))
        return bind(F.struct(up.alias("up"), down.alias("down")), lambda p: F.struct(
            g.alias("g"), b.alias("b"), t.alias("t"), s["mode"].alias("mode"), s["reach"].alias("reach"),
            (s["left"] - p["up"] - p["down"]).alias("left"), p["up"].alias("up"), p["down"].alias("down"),
            F.coalesce(s["found"], F.when(s["left"] < p["up"], x), F.when(s["left"] < p["up"] + p["down"], y)).alias("found")))

    def finish(s: Column) -> Column:
        return F.coalesce(s["found"], s["mode"]).cast("long")

    return bind(given, walk)


def draw_vector(counts: Column, take: Column, *seed: Column | int) -> Column:
    """Multivariate draw: how many of each kind are among ``take`` of ``counts`` (an array)."""
    start = F.struct(
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("rest"), take.cast("long").alias("take"),
        F.array().cast("array<long>").alias("out"))

    def step(s: Column, own: Column) -> Column:
        u = uniform(*seed, F.size(s["out"]))
        return bind(draw(own, s["rest"] - own, s["take"], u), lambda x: F.struct(
            (s["rest"] - own).alias("rest"), (s["take"] - x).alias("take"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(counts, start, step, lambda s: s["out"])


SPREAD_AT = 8


def splitting_tree(root: DataFrame, leaves: int, seed: int) -> DataFrame:
    """Split ``(sizes, counts)`` into one row ``(leaf, size, counts)`` per element of ``sizes``.

    ``counts`` says how many items there are of each kind, ``sizes`` how many
    of them each leaf gets; the sums must agree. Every node halves its leaves
    and draws how many of each kind go to the left half. The leaves together
    hold exactly ``counts``, distributed as after a uniform shuffle of all items.
    Every level is one projection over one row per node, written before the
    next one, so that the plan does not grow with the number of levels.
    """
    nodes = root.select(F.lit(0).alias("leaf"), "sizes", "counts")
    for level in range(max(0, leaves - 1).bit_length()):
        if level == SPREAD_AT:
            nodes = nodes.repartition("leaf")
        half = F.ceil(F.size("sizes") / 2).cast("int")
        split = nodes.withColumn("half", half).withColumn("left", F.slice("sizes", 1, F.col("half")))
        to_left = F.aggregate("left", F.lit(0).cast("long"), lambda a, x: a + x)
        # The halves may take different numbers of levels: a single leaf waits.
        split = split.withColumn("drawn", F.when(F.size("sizes") == 1, F.col("counts")).otherwise(
            draw_vector(F.col("counts"), to_left, F.lit(seed), F.col("leaf"), F.lit(level))))
        own = F.struct("leaf", F.col("left").alias("sizes"), F.col("drawn").alias("counts"))
        other = F.struct(
            (F.col("leaf") + F.col("half")).alias("leaf"),
            F.slice("sizes", F.col("half") + 1, F.greatest(F.lit(0), F.size("sizes") - F.col("half"))).alias("sizes"),
            F.zip_with("counts", "drawn", lambda a, b: a - b).alias("counts"))
        both = F.when(F.size("sizes") == 1, F.array(own)).otherwise(F.array(own, other))
        nodes = stored(split.select(F.explode(both).alias("node")).select("node.*"), "split")
    return nodes.select("leaf", F.col("sizes")[0].alias("size"), "counts")
