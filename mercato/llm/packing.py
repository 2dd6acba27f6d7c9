"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length.
Pieces fall into groups of limited size by a hash. In each group the longest
piece comes first and goes into the open bin that it leaves least room in. If
it fits none, the bin size is opened whose cost is least per token that the
pieces still to come could fill it with. In the end every bin shrinks to the
smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITIES = (512, 1024, 2048, 4096)
# Tokens' worth of cost that a sequence has besides its length.
OVERHEAD = 32
PIECES_PER_GROUP = 20_000
PIECE_TYPE = "id string, mark long, piece int, start long, length int, bin long, capacity int, position int, grp int"


def sequence_cost(capacity: int) -> float:
    return capacity + OVERHEAD


class Remaining:
    """Lengths still to be placed, as a multiset with 'largest at most x'."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.counts = values.tolist(), counts.tolist()

    def take(self, length: int) -> None:
        at = bisect.bisect_left(self.values, length)
        self.counts[at] -= 1
        if not self.counts[at]:
            del self.values[at], self.counts[at]

    def fill(self, room: int) -> int:
        """How much of ``room`` would be used by taking the largest that fits, again and again."""
        free, at = room, len(self.values)
        while free and (at := bisect.bisect_right(self.values, free, 0, at) - 1) >= 0:
            free -= self.values[at] * min(self.counts[at], free // self.values[at])
        return room - free


class OpenBins:
    """Bins by the room that is left in them; of equal ones the first opened is filled first."""

    def __init__(self):
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def put(self, number: int, room: int) -> None:
        if room:
            if room not in self.bins:
                bisect.insort(self.rooms, room)
            self.bins.setdefault(room, []).append(number)

    def best(self, length: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        number = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room], self.rooms[at]
        return number, room


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For lengths in falling order: the bin and offset of each, and the final capacity of each bin."""
    rest, open_bins = Remaining(lengths), OpenBins()
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, used = [], []
    for i, length in enumerate(lengths.tolist()):
        rest.take(length)
        found = open_bins.best(length)
        if found is None:
            sizes = [c for c in capacities if c >= length]
            room = min(sizes, key=lambda c: (cost(c) / (length + rest.fill(c - length)), c))
            number = len(opened)
            opened.append(room)
            used.append(0)
        else:
            number, room = found
        bins[i], offsets[i] = number, used[number]
        used[number] += length
        open_bins.put(number, room - length)
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def packer(capacities: tuple[int, ...], cost: Callable[[int], float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "mark", "piece"], ascending=[False, True, True])
        bins, offsets, final = best_fit(group["length"].to_numpy(), capacities, cost)
        group["bin"] = bins + group["grp"].to_numpy().astype(np.int64) * 2**32
        group["capacity"] = np.asarray(final, dtype="int64")[bins]
        group["position"] = offsets
        return group[["id", "mark", "piece", "start", "length", "bin", "capacity", "position", "grp"]]

    return run


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost,
    pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """Where every token goes: ``(doc_id, piece, start, length, bin, capacity, position)``.

    ``docs`` has ``doc_id`` and ``length`` in tokens; a document longer than
    the largest capacity is cut into pieces (``piece`` from 0, beginning at
    token ``start``), all but the last of that length. ``bin`` is a sequence,
    ``capacity`` its final length and ``position`` the place in it. Documents
    without tokens, or with NULL for a length, have nothing to place: they have
    one row with ``length`` 0 and no bin. Rows are packed one by one, repeated
    ones too. Other columns are ignored; an empty table gives an empty table.
    A group is packed in one task, and has about ``pieces_per_group`` pieces
    however many there are; the loss against one large group is a bin or so.
    """
    most = max(capacities)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select(
        F.col("doc_id").cast("string").alias("id"), F.coalesce("length", F.lit(0)).cast("long").alias("total"),
        F.monotonically_increasing_id().alias("mark")), "lengths")
    cuts = rows.where("total > 0").select(
        "id", "mark", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / most))).alias("piece"))
    pieces = cuts.select(
        "id", "mark", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"),
        F.least(F.col("total") - F.col("piece") * most, F.lit(most)).cast("int").alias("length"))
    total = rows.agg(F.sum(F.ceil(F.col("total") / most))).first()[0] or 0
    groups = max(1, -(-total // pieces_per_group))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("mark", "piece"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("grp").applyInPandas(packer(tuple(sorted(capacities)), cost), PIECE_TYPE)
    nothing = rows.where("total <= 0").select(
        "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("length"),
        F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("position"))
    columns = [F.col("id").cast(kind).alias("doc_id"), "piece", "start", "length", "bin", "capacity", "position"]
    return stored(packed.select(*columns).unionByName(nothing.select(*columns)), "packed")
