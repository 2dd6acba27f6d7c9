"""Runs of words that repeat with a period, by uniting suffixes in order of what they share.

Suffixes of a document's words are sorted, as far as their first words stand
elsewhere in it too. Neighbours are united from the longest common prefix
(LCP) down, Kruskal's way: each class knows its positions in order, and two
positions that become neighbours in it, at a distance no larger than the LCP,
are the first two roots of a run. The LCP says how far the run reaches.

Why this finds each run once: a run from ``i`` with period ``q`` and length
``L`` makes the suffixes at ``i`` and ``i + q`` share exactly ``L - q`` words,
``q`` at least. When they are united there, no position between them is in
the class, or the root would itself be periodic; and a distance that is not
the least period finds its positions parted by one that was united earlier.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from mercato.llm.common import free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS = 12
MIX = np.uint64(0x9E3779B97F4A7C15)
RUNS = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeated_starts(ids: np.ndarray, n: int) -> np.ndarray:
    """Ascending positions whose ``n`` words may stand elsewhere too; equal hashes only leave more than needed."""
    if len(ids) <= n:
        return np.zeros(0, np.int64)
    values = ids.astype(np.uint64)
    hashes = values[: len(ids) - n + 1].copy()
    for i in range(1, n):
        hashes *= MIX
        hashes += values[i : len(ids) - n + 1 + i] + np.uint64(1)
    hashes ^= hashes >> np.uint64(29)
    ordered = np.sort(hashes)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return np.zeros(0, np.int64)
    wanted = ordered[1:][same]
    at = np.searchsorted(wanted, hashes)
    return np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == hashes)


def ranked(order: np.ndarray, keys: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
    """For sorted items, the slot where each one's class begins: equal keys, one class."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return slots[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]


def packed(ids: np.ndarray, n: int, at: np.ndarray) -> list[np.ndarray]:
    """Keys that sort like the ``n`` words at each place, a text's end before all words; several words to a key."""
    wide = max(1, int(ids.max(initial=0) + 1).bit_length())
    padded = np.concatenate([ids + 1, np.zeros(n, np.int64)])
    each = max(1, 63 // wide)
    keys = []
    for first in range(0, n, each):
        key = padded[at + first]
        for i in range(first + 1, min(first + each, n)):
            key = (key << wide) | padded[at + i]
        keys.append(key)
    return keys


def sorted_suffixes(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order, and the LCP of each with the one before (0 where less than ``n``).

    ``starts`` holds every position whose ``n`` words are repeated. Prefixes of
    n, 2n, 4n... words are named by doubling; only suffixes that are not told
    apart yet are sorted again. The names of all lengths give the LCPs.
    """
    size = len(starts)
    own = np.full(len(ids) + 1, -1, np.int64)
    own[starts] = np.arange(size)
    keys = packed(ids, n, starts)
    order = np.lexsort(keys[::-1])
    names = np.empty(size, np.int64)
    names[order] = ranked(order, keys, np.arange(size))
    levels, length = [(n, names)], n
    while True:
        # Items, in their order, of classes that still hold several.
        counts = np.bincount(names, minlength=size)
        slots = np.flatnonzero(counts[names[order]] > 1)
        if not len(slots):
            break
        items = order[slots]
        after = np.minimum(starts[items] + length, len(ids))
        partner = own[after]
        # Words that are not repeated have no name, but no equals either: their own order is enough.
        keys = [names[items], *packed(ids, n, after), np.where(partner >= 0, names[partner], -1)]
        sub = np.lexsort(keys[::-1])
        renamed = names.copy()
        renamed[items[sub]] = ranked(sub, keys, slots)
        order = order.copy()
        order[slots] = items[sub]
        names, length = renamed, 2 * length
        levels.append((length, names))
    above, below = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(max(size - 1, 0), np.int64)
    for length, names in reversed(levels):
        left, right = own[np.minimum(above + shared, len(ids))], own[np.minimum(below + shared, len(ids))]
        both = (left >= 0) & (right >= 0)
        shared[both & (names[left] == names[right])] += length
    # What is shared beyond the last whole length is less than n words.
    open_ = shared >= n
    for _ in range(n - 1):
        a, b = above + shared, below + shared
        open_ &= (a < len(ids)) & (b < len(ids))
        open_[open_] = ids[a[open_]] == ids[b[open_]]
        shared[open_] += 1
    return starts[order], np.concatenate([[0], shared])


def united_seeds(suffixes: np.ndarray, shared: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """``(i, j, lcp)``: positions that become neighbours in a class no farther apart than the LCP that unites it."""
    steps = np.flatnonzero(shared >= n)
    steps = steps[np.argsort(-shared[steps], kind="stable")]
    classes = [[p] for p in suffixes.tolist()]
    parent = list(range(len(classes)))
    seeds = []
    for slot, lcp in zip(steps.tolist(), shared[steps].tolist()):
        a, b = slot - 1, slot
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large, small = classes[a], classes[b]
        last = -1
        for nth, p in enumerate(small):
            at = bisect_left(large, p)
            if at and large[at - 1] > last and p - large[at - 1] <= lcp:
                seeds.append((large[at - 1], p, lcp))
            if at < len(large) and large[at] - p <= lcp and (nth + 1 == len(small) or small[nth + 1] > large[at]):
                seeds.append((p, large[at], lcp))
            last = p
        if len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            large += small
            large.sort()
        classes[b] = []
        parent[b] = a
    return seeds


def periodic_runs(ids: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)``, by start and period."""
    n = max(1, (least + 1) // 2)
    starts = repeated_starts(ids, n)
    if not len(starts):
        return []
    seeds = united_seeds(*sorted_suffixes(ids, starts, n), n)
    found = [(i, j + lcp - i, j - i) for i, j, lcp in seeds if (i == 0 or ids[i - 1] != ids[j - 1]) and j + lcp - i >= least]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    found = np.array(runs)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def finder(text: str, least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            runs, left = [], []
            for value in batch.column(text):
                # bytes.split() without a separator cuts at runs of just the six blanks.
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = periodic_runs(word_ids(words), least) if len(words) >= least else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(b" ".join(collapse(words, found)))
            columns = [*batch.columns, pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed"])

    return find


def find_periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with two columns more: ``runs`` and ``collapsed``.

    ``runs`` lists ``(start, length, period)`` in words from 0, by start and
    period: the stretches with least period ``q`` of at least ``max(least, 2q)``
    words that no neighbouring word continues with that period. ``collapsed``
    is the text of the words that no run holds after its first ``q`` words,
    joined by one blank. Words are cut at the six ASCII blanks and compared as
    they stand. A NULL or empty text has no runs and collapses to an empty one.
    Rows are looked at one by one, so repeated rows are answered alike and an
    empty table gives an empty table; a document of any length takes memory in
    proportion to its words. All other columns are carried along; where the
    table has columns of the two names already, a number is added to the new ones.
    """
    names = [free_name(docs, "runs"), free_name(docs, "collapsed")]
    # Names that Arrow carries are positions: those of the table may be anything.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = StructType([*plain.schema.fields, StructField("runs", RUNS), StructField("collapsed", StringType())])
    return plain.mapInArrow(finder(f"c{docs.columns.index(text)}", least), kinds).toDF(*docs.columns, *names)
