"""Mixing sources to target weights by a splitting tree.

The documents of a source fall into blocks by a hash, so that a block is a
random share of its source. A source's quota is a number of blocks: all of
them for every whole pass over the source, then the first ones, the last of
them cut at the document that meets the target. A tree halves the output
shards and draws, at every node, how many blocks of each source go to the left
half (a multivariate hypergeometric draw). Shards take the next blocks of
every source by these counts, disjoint by construction, and shuffle locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import packed, stored, uniform, unpacked, word_count
from mercato.llm.hypergeometric import splitting_tree

MOST_PASSES = 3
MAX_BLOCKS, BLOCK_WORDS = 65_536, 20_000
ROWS_PER_BUCKET = 4096


def random_key(key: Column, text: Column, seed: int) -> Column:
    """A repeatable number below 2**52 that also SQL engines can compute."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] = (1, 2, 3), most: float = MOST_PASSES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in the order of their code points, NULL last, weigh ``weights``,
    repeating. Targets share the total size by weight, but none is above
    ``most`` times its source's size; what is above is shared again among the
    others. That is one level ``x`` with ``target = min(most * size, x * weight)``,
    found by trying how many of the sources, by cap per weight, are capped.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights)).cast("int") + 1)
    placed = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    up = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level if exactly the sources before this one are capped; right where it leaves this one below its cap.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    tried = placed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    # Capping further sources only lowers the level.
    found = tried.withColumn("x", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    return found.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("x") * F.col("w"), F.col("cap"))).alias("target"))


def quotas(docs: DataFrame, targets: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their block; blocks taken, ``(source_no, block, pass, nth)``; and documents cut off.

    ``nth`` numbers the blocks a source gives, in the order of passes and
    random blocks. The number of blocks per source is limited, so that windows
    over them stay small and blocks grow with the source instead.
    """
    count = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("long")
    known = stored(targets.withColumn("source_no", F.monotonically_increasing_id()).withColumn("blocks", count), "targets")
    placed = docs.join(known, docs["source"].eqNullSafe(known["source"])).select(
        docs["*"], "source_no", "source_size", "target",
        F.floor(F.col("r") / 2.0**52 * F.col("blocks")).cast("long").alias("block"))
    placed = stored(placed, "blocks")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sums = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = Window.partitionBy("source_no").orderBy("block")
    sums = sums.withColumn("passes", passes).select(
        "source_no", "block", "words", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
        F.sum("words").over(order).alias("up_to"),
        F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("source_no")).alias("n"))
    last = F.when((F.col("up_to") - F.col("words")) < F.col("rest"), 1).otherwise(0)
    taken = sums.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(MOST_PASSES + 1).cast("long"))).alias("pass"))
    taken = taken.where((F.col("pass") <= F.col("passes")) | ((F.col("pass") == F.col("passes") + 1) & (last == 1)))
    units = stored(taken.select(
        "source_no", "block", "pass", ((F.col("pass") - 1) * F.col("n") + F.col("rank") - 1).alias("nth")), "units")
    # In the block where the target lies, documents count up to it; equal ones stand or fall together.
    edge = sums.where((F.col("up_to") - F.col("words") < F.col("rest")) & (F.col("up_to") > F.col("rest"))).select(
        "source_no", "block", (F.col("passes") + 1).alias("pass"), (F.col("rest") - F.col("up_to") + F.col("words")).alias("room"))
    within = Window.partitionBy("source_no", "block").orderBy("r").rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy("source_no", "block", "r")
    cut = placed.join(edge, ["source_no", "block"]).withColumn(
        "middle", F.sum("size").over(within) - F.sum("size").over(peers) / 2).where("middle > room")
    return placed, units, stored(cut.select("pos", "pass"), "cut")


def mix(docs: DataFrame, shards: int = 8, seed: int = 0, weights: list[float] = (1, 2, 3), block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows considered and the rows of the mix, without their texts.

    Considered: ``(pos, id, mark, size, source_size, target)``, one per row of ``docs``.
    Mix: ``(pos, id, mark, size, pass, shard, slot)``, one per time a row is
    taken, at most 3; ``slot`` counts from 0 in every shard.
    ``size`` is the number of words, 0 for NULL. NULL is a source of its own
    and comes last. Rows that repeat id and text are taken equally often.
    Columns other than ``doc_id, text, source`` are ignored. An empty table
    gives an empty mix, and so does one without words. The same rows give the
    same mix on every run, whatever their order.
    """
    key = random_key(F.col("doc_id"), F.col("text"), seed)
    rows = stored(docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), key.alias("r"), F.monotonically_increasing_id().alias("pos")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    placed, units, cut = quotas(rows, targets, block_words)
    considered = placed.select("pos", "id", "mark", "size", "source_size", "target")
    dealt = deal(units, shards, seed)
    copies = placed.join(dealt, ["source_no", "block"]).join(cut, ["pos", "pass"], "left_anti")
    return considered, local_shuffle(copies.select("pos", "id", "mark", "size", "r", "pass", "shard"), shards, seed)


def deal(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """``units`` with the ``shard`` that each block goes to."""
    quota = units.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
    root = quota.agg(F.sort_array(F.collect_list(F.struct("source_no", "n"))).alias("all")).select(
        F.col("all.source_no").alias("sources"), F.col("all.n").alias("counts"),
        F.aggregate("all.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    sizes = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    root = stored(root.withColumn("sizes", sizes), "quotas")
    leaves = splitting_tree(root.select("sizes", "counts"), shards, seed)
    shares = leaves.select("leaf", F.posexplode("counts").alias("kind", "n"))
    # A source's blocks up to ``ends[s]`` go to the shards up to ``s``: one row per source.
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("shares.n", 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    lists = shares.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("leaf", "n"))).alias("shares")).withColumn("ends", ends)
    names = root.select(F.posexplode("sources").alias("kind", "source_no"))
    lists = stored(lists.join(names, "kind").select("source_no", "ends"), "deal")
    return units.join(lists, "source_no").select(
        "source_no", "block", "pass", F.size(F.filter("ends", lambda e: e <= F.col("nth"))).alias("shard"))


def local_shuffle(copies: DataFrame, shards: int, seed: int) -> DataFrame:
    """``copies`` with a random ``slot`` in their shard, ranked in buckets of limited size."""
    mixed = stored(copies.withColumn("key", uniform(F.col("r"), F.col("pass"), seed)), "copies")
    buckets = max(1, -(-mixed.count() // (shards * ROWS_PER_BUCKET)))
    mixed = mixed.withColumn("bucket", F.floor(F.col("key") * buckets).cast("int"))
    sizes = mixed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "offsets")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "pass", "pos")) - 1
    return mixed.withColumn("rank", rank).join(firsts, ["shard", "bucket"]).select(
        "pos", "id", "mark", "size", "pass", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, source_size, target, taken, shards)``."""
    considered, mixed = mix(docs, **options)
    taken = mixed.groupBy("pos").agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    return considered.join(taken, "pos", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns; texts move once."""
    considered, mixed = mix(docs, **options)
    times = stored(
        mixed.groupBy("pos").agg(F.first("id").alias("_t_id"), F.first("mark").alias("_t_mark"), F.count(F.lit(1)).alias("times"))
        .groupBy("_t_id", "_t_mark").agg(F.max("times").cast("int").alias("times")), "times")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    met = rows.join(times, rows["id"].eqNullSafe(times["_t_id"]) & (rows["mark"] == times["_t_mark"]))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*unpacked(docs, "row"))
