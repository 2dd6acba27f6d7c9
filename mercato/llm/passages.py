"""Passages that occur more than once, by sparse suffixes at minimisers.

Of every 50 words in a row the least of their hashed runs of 10 words is the
minimiser: the words themselves select it, so equal passages select alike. Only
these suffixes are kept, one for some 20 words, and sorted; where neighbours
begin with the same run, matches are possible. Around these the suffixes are
extended to the left and right, to all stretches of 50 words that they lead,
and the extended ones are compared again. What matches is merged into passages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored
from mercato.llm.shingles import run_hashes, sliding_min, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS, RUN_WORDS = 50, 10
# Suffixes with one leading run that a task compares together; those of more frequent runs are compared stretch by stretch.
TOGETHER = 20_000
# Stretches that a task holds at once, besides one leading run's.
BUNDLE = 200_000


def stretches(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All stretches of ``least`` words: the text and place of each, its minimiser and its hash."""
    words, bounds = word_hashes(texts)
    counts = np.maximum(np.diff(bounds) - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = bounds[:-1][owner] + place
    leading = sliding_min(run_hashes(words, RUN_WORDS), least - RUN_WORDS + 1)
    return owner, place, leading[at].astype(np.int64), run_hashes(words, least)[at].astype(np.int64)


def suffix_starts(owner: np.ndarray, leading: np.ndarray) -> np.ndarray:
    """Where a suffix begins to lead: the first of the neighbouring stretches that have one minimiser."""
    if not len(owner):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (leading[1:] != leading[:-1])]))


def sampler(least: int):
    """Rows ``(id, mark, run, own)``: the suffixes kept of each text; ``own`` if it repeats a stretch by itself."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, _, leading, hashes = stretches(batch.column("text").to_pylist(), least)
            starts = suffix_starts(owner, leading)
            own = np.zeros(len(starts), bool)
            if len(starts):
                nth = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
                order = np.lexsort((hashes, nth))
                twice = (nth[order][1:] == nth[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
                own[nth[order][1:][twice]] = True
            taken = pa.array(owner[starts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("mark").take(taken), pa.array(leading[starts]), pa.array(own)],
                ["id", "mark", "run", "own"])

    return sample


def extender(least: int):
    """Rows ``(id, mark, run, start, hashes)``: of the wanted suffixes, all stretches that they lead."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, leading, hashes = stretches(batch.column("text").to_pylist(), least)
            starts = suffix_starts(owner, leading)
            ends = np.append(starts[1:], len(owner))
            wanted = [set(x) for x in batch.column("runs").to_pylist()]
            kept = [i for i, s in enumerate(starts.tolist()) if int(leading[s]) in wanted[int(owner[s])]]
            lengths = ends[kept] - starts[kept]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = hashes[np.repeat(starts[kept] - offsets[:-1], lengths) + np.arange(int(offsets[-1]))] if kept else hashes[:0]
            taken = pa.array(owner[starts[kept]] if kept else [], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(taken), batch.column("mark").take(taken), pa.array(leading[starts[kept]] if kept else [], pa.int64()),
                pa.array(place[starts[kept]] if kept else [], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())),
            ], ["id", "mark", "run", "start", "hashes"])

    return extend


def matcher(least: int):
    """Sorted suffixes to spans ``(id, mark, start, until)`` of words that lie in repeated stretches."""

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = table.column("hashes").combine_chunks()
        flat = column.flatten().to_numpy()
        if not len(flat):
            return None
        lengths = np.diff(column.offsets.to_numpy())
        nth = np.repeat(np.arange(len(lengths)), lengths)
        place = table.column("start").to_numpy()[nth] + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice)
        if not len(hit):
            return None
        # Neighbouring places of one suffix make one span.
        first = np.concatenate([[True], (nth[hit][1:] != nth[hit][:-1]) | (hit[1:] != hit[:-1] + 1)])
        begin = hit[first]
        end = hit[np.append(np.flatnonzero(first)[1:] - 1, len(hit) - 1)]
        taken = pa.array(nth[begin], pa.int64())
        return pa.RecordBatch.from_arrays([
            table.column("id").combine_chunks().take(taken), table.column("mark").combine_chunks().take(taken),
            pa.array(place[begin], pa.int32()), pa.array(place[end] + least, pa.int32()),
        ], ["id", "mark", "start", "until"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column("hashes").flatten())
            if size < BUNDLE:
                continue
            # All but the last leading run, which may go on, are complete.
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            runs = table.column("run").to_numpy()
            cut = int(np.searchsorted(runs, runs[-1]))
            if cut:
                if (out := spans([table.slice(0, cut)])) is not None:
                    yield out
                table = table.slice(cut)
            held, size = [table], len(table.column("hashes").flatten())
        if held and (out := spans(held)) is not None:
            yield out

    return match


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per passage: ``(key, start, n_words, mark)``, places in words from 0.

    A stretch of ``least`` words is repeated when the same words (A-Z in lower
    case) stand in two places at least, of one document or of two. A passage is
    what overlapping and touching repeated stretches of a document cover: its
    words are exactly those that lie in a repeated stretch. Texts with fewer
    words, NULL among them, have no passage. Rows that repeat key and text are
    two places, and are reported once. Other columns are ignored, an empty
    table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kept = stored(asked.mapInArrow(sampler(least), f"id {kind}, mark long, run long, own boolean"), "suffixes")
    counted = kept.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    shared = stored(counted.where("n > 1 OR own").select("run", (F.col("n") > TOGETHER).alias("hot")), "shared")
    lists = kept.join(shared.select("run"), "run").groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set("run").alias("runs"))
    met = asked.join(lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("id", "mark", "text", "runs")
    extended = stored(
        met.mapInArrow(extender(least), f"id {kind}, mark long, run long, start int, hashes array<long>"), "extended")
    hot = shared.where("hot").select("run")
    few = extended.join(hot, "run", "left_anti")
    span = f"id {kind}, mark long, start int, until int"
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = few.repartition(spread, "run").sortWithinPartitions("run").mapInArrow(matcher(least), span)
    # Very frequent runs: their stretches one by one, counted on the map side first.
    single = extended.join(hot, "run").select("id", "mark", "start", F.posexplode("hashes").alias("nth", "hash"))
    twice = stored(single.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "frequent")
    begin = F.col("start") + F.col("nth")
    often = single.join(twice, "hash").select("id", "mark", begin.alias("start"), (begin + least).alias("until"))
    every = stored(found.unionByName(often), "spans").groupBy("id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "until"))).alias("spans"))
    grown = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,until:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["until"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.get(done, F.size(done) - 1)["start"].alias("start"),
                F.greatest(F.get(done, F.size(done) - 1)["until"], s["until"]).alias("until")))),
        ).otherwise(F.concat(done, F.array(s))))
    return every.select("id", "mark", F.inline(grown)).select(
        F.col("id").alias(key), "start", (F.col("until") - F.col("start")).alias("n_words"), "mark")
