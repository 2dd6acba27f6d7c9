"""Exact deduplication by recipes of content-defined chunks.

Each text is cut where its own bytes say so, hence equal texts are cut alike.
A chunk travels once, to be checked byte for byte against the other chunks of
its hash; that makes a verified identifier. Afterwards a document is only its
ordered list of identifiers (its recipe), 8 bytes for some 4 KB of text, and
documents are equal when their recipes are.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import keep_rows, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 1024, 4096, 65536
# Bytes of a text that are looked at together, and of chunks that are passed on together.
BLOCK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def good_ends(data: bytes, at: int, mean: int) -> np.ndarray:
    """Ends of the windows of 8 bytes that begin in the block at ``at`` and have a small hash."""
    raw = np.frombuffer(data, np.uint8, min(BLOCK + 7, len(data) - at), at)
    window = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        window |= raw[i : len(window) + i].astype(np.uint64) << np.uint64(8 * i)
    window *= MIX
    return np.flatnonzero(window >> np.uint64(32) < np.uint64(2**32 // mean)) + (8 + at)


def cut_points(data: bytes, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks: after 8 bytes whose hash is small, but no chunk is under ``least`` or over ``most``."""
    size = len(data)
    if size <= least:
        return [size]
    wanted = np.concatenate([good_ends(data, at, mean) for at in range(0, size - 7, BLOCK)])
    cuts, start = [], 0
    while size - start > least:
        nth = np.searchsorted(wanted, start + least)
        end = int(wanted[nth]) if nth < len(wanted) else size
        start = min(end, start + most, size)
        cuts.append(start)
    if start < size:
        cuts.append(size)
    return cuts


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; other letters stay. NULL counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def pieces(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cut_points(data):
        out.append(data[start:end])
        start = end
    return out


def chunk_hash(piece: bytes, bits: int) -> int:
    """The leading ``bits`` of the chunk's hash; fewer than 64 only serve to provoke collisions."""
    return xxhash.xxh3_64_intdigest(piece) - 2**63 >> 64 - bits


def chunker(bits: int):
    """Rows ``(id, mark, nth, hash, piece)`` of the chunks of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                parts = pieces(normalised(batch.column("text")[row].as_py()))
                own = pa.array([row] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(own), batch.column("mark").take(own), pa.array(range(len(parts)), pa.int32()),
                    pa.array([chunk_hash(p, bits) for p in parts], pa.int64()), pa.array(parts, pa.binary()),
                ], ["id", "mark", "nth", "hash", "piece"])

    return cut


def recipe_writer(bits: int):
    """Rows ``(id, mark, text_sha256, recipe)``, one per text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, recipes = [], []
            for text in batch.column("text"):
                data = normalised(text.as_py())
                shas.append(hashlib.sha256(data).hexdigest())
                recipes.append([chunk_hash(p, bits) for p in pieces(data)])
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("mark"), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64())),
            ], ["id", "mark", "text_sha256", "recipe"])

    return write


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``(id, mark, text_sha256, recipe, variants)`` of ``docs`` with columns ``id, mark, text``.

    ``recipe`` lists the chunk hashes. ``variants`` is empty, unless one of
    these hashes stands for several different chunks somewhere; then it says
    for each such place which of them is meant. Both together are the ordered
    list of verified identifiers.
    """
    kind = docs.schema["id"].dataType.simpleString()
    chunks = docs.mapInArrow(chunker(bits), f"id {kind}, mark long, nth int, hash long, piece binary")
    # Copies of a chunk meet on the map side: one that a third of the documents hold is one row per task.
    seen = chunks.groupBy("hash").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    collided = stored(seen.where("lo <> hi").select("hash"), "collided")
    plain = docs.mapInArrow(recipe_writer(bits), f"id {kind}, mark long, text_sha256 string, recipe array<long>")
    if collided.isEmpty():
        return plain.withColumn("variants", F.array().cast("array<struct<nth:int,variant:int>>"))
    doubtful = chunks.join(collided, "hash")
    ranked = doubtful.select("hash", "piece").distinct().withColumn(
        "variant", F.row_number().over(Window.partitionBy("hash").orderBy("piece")))
    told = doubtful.join(ranked, ["hash", "piece"]).groupBy("id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("nth", "variant"))).alias("variants"))
    told = told.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "variants")
    joined = plain.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.drop("_id", "_mark").withColumn(
        "variants", F.coalesce("variants", F.array().cast("array<struct<nth:int,variant:int>>")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: ``(key, keep_id, group_size, kept, text_sha256, mark)``.

    Texts are equal when they agree after lower-casing A-Z. Of equal texts the
    row with the largest key stays; a NULL key is below all others, and a NULL
    text counts as empty. If rows repeat key and text, one of them is ``kept``.
    ``mark`` is a hash of the text as it stands, for joining the rows again.
    Other columns are ignored; an empty table gives an empty table.
    """
    asked = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    written = stored(recipes(asked, bits), "recipes")
    groups = stored(
        written.groupBy("recipe", "variants").agg(
            F.max(F.struct("id", "mark")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"), "groups")
    rows = written.groupBy("id", "recipe", "variants", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.first("text_sha256").alias("text_sha256"))
    alone = F.struct("id", "mark")
    judged = rows.join(groups, ["recipe", "variants"], "left").select(
        "id", "mark", "text_sha256", F.coalesce("keep", alone).alias("keep"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("mark") == F.col("keep.mark")) & (F.col("nth") == 1)
    return judged.select(
        F.col("id").alias(key), F.col("keep.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", "mark")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, stored(exact_groups(docs, key, text, bits).select(key, "mark", "kept"), "verdicts"), key, text)
