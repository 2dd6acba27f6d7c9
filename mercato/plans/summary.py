"""Summaries of chunks by their central sentences.

Sentences are linked by the words that they share, each word weighted by its
rarity within the chunk. A walk along these links stays longest at the central
sentences. The walk goes from sentences to words and back, over the list of
sentences of each word, so no two sentences are ever compared: the work grows
with the words of a chunk, not with the square of its sentences.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCES, STEPS, STAY = 2, 60, 0.85
END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[str]:
    """Pieces between line breaks, or after a full stop, ``!`` or ``?`` with a blank; without blanks at their ends."""
    return [s for s in (part.strip() for part in END.split(text or "")) if s]


def word_lists(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-zero weights of sentences by words: sentence, word, weight; every sentence has length 1.

    A word's weight is its count times ``ln(1 + sentences / sentences with it)``.
    """
    known: dict[str, int] = {}
    rows, columns, counts = [], [], []
    for i, part in enumerate(parts):
        seen: dict[int, int] = {}
        for word in WORD.findall(part.lower()):
            place = known.setdefault(word, len(known))
            seen[place] = seen.get(place, 0) + 1
        rows += [i] * len(seen)
        columns += seen.keys()
        counts += seen.values()
    row, column = np.array(rows, np.int64), np.array(columns, np.int64)
    held = np.bincount(column, minlength=len(known))
    weight = np.array(counts, float) * np.log1p(len(parts) / held[column]) if len(row) else np.zeros(0)
    length = np.sqrt(np.bincount(row, weight * weight, len(parts)))
    return row, column, weight / length[row] if len(row) else weight


def centrality(parts: list[str]) -> np.ndarray:
    """Share of a long walk at each sentence; a step follows a link with probability ``STAY``, else goes anywhere."""
    n = len(parts)
    row, column, weight = word_lists(parts)
    words = int(column.max(initial=-1)) + 1

    def linked(x: np.ndarray) -> np.ndarray:
        """Sums over all linked sentences, by way of the words."""
        by_word = np.bincount(column, weight * x[row], words)
        return np.bincount(row, weight * by_word[column], n)

    degree = linked(np.ones(n))
    share = np.full(n, 1.0 / n)
    # A sentence without words has no links: from there a step goes anywhere.
    lost = degree == 0
    degree[lost] = 1.0
    for _ in range(STEPS):
        share = (1 - STAY) / n + STAY * (linked(share / degree) + share[lost].sum() / n)
    return share


def central(text: str | None, most: int) -> str:
    """The ``most`` central sentences in their order, joined by blanks; the first of equals, to nine digits."""
    parts = sentences(text)
    if len(parts) <= most:
        return " ".join(parts)
    scores = np.round(centrality(parts), 9)
    best = sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:most]
    return " ".join(parts[i] for i in sorted(best))


def central_summary(chunks: DataFrame, text: str = "text", out: str = "summary", most: int = SENTENCES) -> DataFrame:
    """``chunks`` with the column ``out``: its ``most`` central sentences; empty for a NULL or empty text."""
    place, names = chunks.columns.index(text), chunks.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([central(t, most) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "summary"])

    plain = chunks.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = StructType([*plain.schema.fields, StructField("summary", StringType())])
    return plain.mapInArrow(add, kinds).toDF(*names, out)
