"""Hashes of words and of runs of words, for whole batches of texts at once."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
# Bytes that are hashed together; texts are cut at blanks.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on all others afterwards."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = ODD) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a block that cuts no word."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = raw[solid].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(lengths.max()))[within]
    return starts, mixed(np.add.reduceat(letters, first) + lengths.astype(np.uint64) * STEP)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, A-Z in lower case, and where each text begins among them.

    The second array has one element more than there are texts.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    offsets = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=offsets[1:])
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8) if data else np.zeros(0, np.uint8)
    at, places, hashes = 0, [], []
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw):
            stretch = raw[end : end + BLOCK]
            blank = np.flatnonzero((stretch == 32) | ((stretch >= 9) & (stretch <= 13)))
            if len(blank):
                end += int(blank[0]) + 1
                break
            end += len(stretch)
        starts, found = block_hashes(raw[at:end])
        places.append(starts + at)
        hashes.append(found)
        at = end
    if not places:
        return np.zeros(0, np.uint64), np.zeros(len(data) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; runs may cross texts, callers pick those that do not.

    A run's polynomial is put together from those of 1, 2, 4... words.
    """
    size, part, length, out = 1, words, 0, None
    if len(words) < n:
        return np.zeros(0, np.uint64)
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                room = len(part) - length
                out = out[:room] * power(size) + part[length:]
            length += size
        if 2 * size > n:
            return mixed(out)
        part = part[:-size] * power(size) + part[size:]
        size *= 2


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(ODD), n, 2**64))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` values in a row."""
    size, part = 1, values
    if len(values) < n:
        return values[:0]
    while 2 * size <= n:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    rest = n - size
    return np.minimum(part[: len(part) - rest], part[rest:])


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of every text, in a row, and where each text begins among them.

    A text with fewer words has a single shingle of all of them, one without words has none.
    """
    counts = np.diff(bounds)
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=begins[1:])
    runs = run_hashes(words, n)
    wanted = np.repeat(bounds[:-1] - begins[:-1], many) + np.arange(int(begins[-1]))
    out = np.zeros(int(begins[-1]), np.uint64)
    inside = wanted < len(runs)
    out[inside] = runs[wanted[inside]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[bounds[i] : bounds[i + 1]]
        out[begins[i]] = mixed(run_hashes(own, len(own)) + np.full(1, len(own), np.uint64) * STEP)[0]
    return out, begins


def sequence_key(words: np.ndarray) -> bytes:
    """128 bits that name a sequence of words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
