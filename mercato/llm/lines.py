"""Lines that many documents share, dropped from all but one of them.

Lines are exploded and hashed, documents are counted per hash, and the places
of frequent lines are joined back to their documents, which are put together
again by position. A line travels as 128 bits of hash; texts travel only with
the join that brings a document its dropped places.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import BLANKS, bind, discard, free_name, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_CHARS, LEAST_DOCS = 40, 5
# A line that more than this share of all places holds is looked up on the map side; there are fewer of them than 1 / share.
HOT_SHARE = 1e-4
STRIPPED = BLANKS.encode()


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(STRIPPED).lower()


def code_points(key: bytes) -> int:
    """Characters of UTF-8 bytes: those that do not continue another one."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def hasher(least: int):
    """Rows ``(id, mark, place, high, low)``: every line long enough, numbered from 0, as the two halves of its key's hash."""

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                for place, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(line) >= least and len(key := line_key(line)) >= least and code_points(key) >= least:
                        owners.append(row)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(key))
            taken = pa.array(owners, pa.int64())
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(taken), batch.column("mark").take(taken), pa.array(places, pa.int32()),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]),
            ], ["id", "mark", "place", "high", "low"])

    return hash_lines


def frequent_lines(lines: DataFrame, least: int) -> DataFrame:
    """``(high, low, n, keeper)`` of the lines in ``least`` documents or more; ``keeper`` is the largest id among them.

    Ids are made distinct per line before they are counted, so that a line
    which every document holds meets in one task only as counts.
    """
    pairs = lines.select("high", "low", "id").distinct()
    return pairs.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= least)


def dropped_places(lines: DataFrame, least: int) -> DataFrame:
    """``(id, mark, places)``: places of the lines that go, for documents that lose any.

    The few lines that hold a large share of all places are looked up where the
    places are read (at most ``1 / HOT_SHARE`` of them, however large the
    table); the others meet their places by a shuffle, none with more than that share.
    """
    frequent = stored(frequent_lines(lines, least), "frequent-lines")
    most = lines.count() * HOT_SHARE
    keys = ["high", "low"]
    hot, cold = frequent.where(F.col("n") > most).drop("n"), frequent.where(F.col("n") <= most).drop("n")
    rare = lines.join(F.broadcast(hot), keys, "left_anti").join(cold, keys)
    met = rare.unionByName(lines.join(F.broadcast(hot), keys))
    gone = met.where(~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "mark").agg(F.collect_set("place").alias("places"))


def without(lines: Column, places: Column) -> Column:
    """The lines at all other places, joined again; linear in their number."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return bind(lines, lambda held: F.array_join(F.transform(left, lambda i: F.get(held, i)), "\n"))


def drop_shared_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """The rows of ``docs`` with ``text`` as it is left, and two columns ``n_lines`` and ``n_dropped`` more.

    A line's key is the line without blanks at its ends, A-Z in lower case. A
    key of at least ``least_chars`` code points that at least ``least_docs``
    documents hold loses its lines in all documents but the one with the
    largest ``key``, where all of them stay. Documents are counted by distinct
    ``key``; NULL is one, below all others, and rows that repeat a key are one
    document and are treated alike. Order, empty lines and blanks of the lines
    that stay are kept. A NULL or empty text is one empty line and stays as it
    is; a text that loses all its lines becomes empty. All other columns stay;
    where the table has columns of the two names already, a number is added to
    the new ones. An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"))
    lines = stored(asked.mapInArrow(hasher(least_chars), f"id {kind}, mark long, place int, high long, low long"), "lines")
    gone = stored(dropped_places(lines, least_docs), "dropped-lines")
    discard(lines)
    n_lines, n_dropped, mark, told_id, told_mark, told_places = (
        free_name(docs, wish) for wish in ("n_lines", "n_dropped", "_mark", "_told_id", "_told_mark", "_told_places"))
    value, places = F.col(f"`{text}`"), F.col(told_places)
    marked = docs.withColumn(mark, F.xxhash64(value))
    told = gone.select(F.col("id").alias(told_id), F.col("mark").alias(told_mark), F.col("places").alias(told_places))
    met = marked.join(told, F.col(f"`{key}`").eqNullSafe(F.col(told_id)) & (F.col(mark) == F.col(told_mark)), "left")
    left = F.when(places.isNull(), value).otherwise(without(F.split(value, "\n"), places))
    line_ends = F.octet_length(value) - F.octet_length(F.replace(value, F.lit("\n"), F.lit("")))
    return met.select(
        *[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        (F.coalesce(line_ends, F.lit(0)) + 1).cast("long").alias(n_lines),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias(n_dropped))
