"""Connected components of a graph that no task holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes of ``edges (a, b)``; the label is the component's least node.

    In every round each node hooks on to the least node around it, and hooks are
    followed to their ends by doubling. Edges are renamed to the ends that their
    nodes reach; loops and repeats go. At least half of the nodes vanish, so the
    rounds shrink quickly and move a few rows per edge in all. Hooks and edges
    are written to the shared folder. An end that very many nodes share is the
    only hot key, in joins of two written tables that adaptive execution can split.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = stored(edges.where("a <> b").select(a, b).distinct(), "edges")
    labels = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not left.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node")))).alias("end")
        hooks = stored(left.select("a", ends).groupBy(F.col("end.node").alias("node")).agg(F.min("a").alias("hook")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("top"))
            hooks = stored(hooks.join(above, "hook").select("node", F.col("top").alias("hook"), F.col("hook").alias("before")), "hooks")
            if hooks.where("hook <> before").isEmpty():
                break
            hooks = hooks.drop("before")
        at_a, at_b = (hooks.select(F.col("node").alias(c), F.col("hook").alias(f"{c}_hook")) for c in "ab")
        named = stored(left.join(at_a, "a").select("a_hook", "b"), "renamed")
        named = named.join(at_b, "b").where("a_hook <> b_hook").select(
            F.least("a_hook", "b_hook").alias("a"), F.greatest("a_hook", "b_hook").alias("b")).distinct()
        left = stored(named, "edges")
        moved = hooks.select(F.col("node").alias("label"), F.col("hook").alias("new"))
        labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    return labels
