"""Words that differ in one letter, found by an index of grams of variable length.

A dictionary of grams is grown from the vocabulary: grams that stand in many
words are prolonged, rare ones are selective enough as they are. Words are cut
into the longest grams of the dictionary. For every word, the most grams that
one edit can affect bounds how many lists must be merged: that many of its
rarest grams and one more. Two near words always meet in one of these lists;
what meets is verified letter by letter.

The longest gram in use is half of a word at most. Then one edit never affects
all grams: the first one ends before it, or the last one begins after it.
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

from mercato.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# Shortest and longest grams.
SHORT, LONG = 2, 6
# A gram is prolonged when it has more than this share of all letters; there are at most (LONG - SHORT) / share such grams.
SHARE = 1 / 20_000
# Words of a list that are compared with each other in one task, and pairs that are compared at once.
BLOCK, TOGETHER = 1_000, 200_000


def frequent_grams(vocabulary: DataFrame, share: float = SHARE) -> dict[str, int]:
    """The grams to prolong, with their counts over the vocabulary ``(word, n)``.

    Every beginning of such a gram is one as well. Their number is bounded by
    the share, however large the vocabulary, so they may pass the driver.
    """
    letters = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    sizes = F.explode(F.array(*[F.lit(n) for n in range(SHORT, LONG)])).alias("size")
    sized = vocabulary.select("word", sizes).where(F.col("size") <= F.length("word"))
    starts = F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("at")
    grams = sized.select("word", "size", starts).groupBy(F.substr("word", F.col("at"), F.col("size")).alias("gram")).agg(
        F.count(F.lit(1)).alias("n"))
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") > max(1.0, letters * share)).collect()}


class GramDictionary:
    """Cuts words into grams that are at most ``longest`` letters long."""

    def __init__(self, frequent: dict[str, int], longest: int):
        self.longest, self.counts = longest, frequent
        self.prolonged = {g for g in frequent if len(g) < longest}
        # What a gram of the dictionary may end with, without its last letter.
        self.inner = {g[i:] for g in self.prolonged for i in range(1, len(g))}

    def grams(self, word: str) -> list[tuple[int, str]]:
        """``(place, gram)``: the longest gram at every place, but none inside the one before."""
        out, covered = [], 0
        for at in range(len(word) - SHORT + 1):
            end = at + SHORT
            while end < len(word) and word[at:end] in self.prolonged:
                end += 1
            if end > covered:
                out.append((at, word[at:end]))
                covered = end
        return out

    def affected(self, word: str, grams: list[tuple[int, str]], until: int, begin: int) -> int:
        """Most grams of ``word`` that may be lost when the letters from ``until`` to before ``begin`` become others.

        Left of the edit a gram is safe if no gram from its place or before can
        be prolonged into the new letters; right of it, if none that comes out
        of them can cover it.
        """
        reach = max(until - 1, 0)
        for at in range(max(0, until - self.longest + 1), until - 1):
            if word[at:until] in self.prolonged:
                reach = at
                break
        lost = 0
        for at, gram in grams:
            end = at + len(gram)
            left = end <= until and at < reach
            right = at >= begin and word[begin : end - 1] not in self.inner
            lost += not (left or right)
        return lost

    def rarest(self, word: str, longer: bool) -> list[tuple[int, str]]:
        """The grams whose lists ``word`` enters: one more than an edit affects, the rarest first.

        A word that is the ``longer`` of two loses a letter; the others get
        another letter in place of one, or one more.
        """
        grams, n = self.grams(word), len(word)
        edits = [(i, i + 1) for i in range(n)] + ([] if longer else [(i, i) for i in range(n + 1)])
        most = max(self.affected(word, grams, until, begin) for until, begin in edits)
        return sorted(grams, key=lambda g: (self.counts.get(g[1], 0), g[1], g[0]))[: most + 1]


def longest_gram(length: int) -> int:
    return max(SHORT, min(LONG, length // 2))


def list_name(length: int, gram: str, place: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{length}|{place}|{gram}".encode("utf-8", "surrogatepass")) - 2**63


def indexer(frequent: dict[str, int], least: int):
    """Rows ``(list, longer, word, n)``: the lists that each word enters.

    A list belongs to a length: it holds words of that length, to be compared
    with each other and with the ``longer`` ones of one letter more. These may
    have the gram at the list's place or one further.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries = {}
        for batch in batches:
            lists, longer, taken = [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                for more in (False, True):
                    length = len(word) - more
                    if length < least:
                        continue
                    longest = longest_gram(length)
                    if longest not in dictionaries:
                        dictionaries[longest] = GramDictionary(frequent, longest)
                    found = {list_name(length, gram, place - back)
                             for place, gram in dictionaries[longest].rarest(word, more) for back in range(more + 1) if place >= back}
                    lists += found
                    longer += [more] * len(found)
                    taken += [row] * len(found)
            rows = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int64()), pa.array(longer, pa.bool_()), batch.column("word").take(rows), batch.column("n").take(rows)],
                ["list", "longer", "word", "n"])

    return index


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, filled up with 0, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    wide = int(lengths.max(initial=0)) + 1
    return np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide), lengths


def one_edit(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``a`` becomes ``b`` by replacing or adding exactly one letter."""
    x, y = codes[a], codes[b]
    same = x == y
    replaced = (lengths[a] == lengths[b]) & ((~same).sum(1) == 1)
    front = np.argmin(same, axis=1)
    moved = x[:, :-1] == y[:, 1:]
    # Columns after the last one that differs when b is shifted by one letter.
    back = np.where(moved.all(1), moved.shape[1], np.argmin(moved[:, ::-1], axis=1))
    added = (lengths[a] + 1 == lengths[b]) & (moved.shape[1] - back <= front)
    return replaced | added


def verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(word, other, n)`` of near words, from lists that are sorted by ``(list, low, high)``."""

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, lengths = letters(table.column("word").to_pylist())
        names, low, high, block = (table.column(c).to_numpy() for c in ("list", "low", "high", "block"))
        longer, n = table.column("longer").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        words = table.column("word").combine_chunks()
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(names)), 0))
        before = np.arange(len(names)) - first
        upto = np.cumsum(before)
        start = 0
        while start < len(names):
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + TOGETHER, "right")))
            b = np.repeat(np.arange(start, end), before[start:end])
            a = np.arange(len(b)) - np.repeat(np.cumsum(before[start:end]) - before[start:end], before[start:end]) + first[b]
            start = end
            asked = ~(longer[a] & longer[b]) & ((block[a] != block[b]) | (low[a] == high[a]))
            a, b = a[asked], b[asked]
            swap = longer[a]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            hit = one_edit(codes, lengths, a, b) if len(a) else np.zeros(0, bool)
            a, b = pa.array(np.concatenate([a[hit], b[hit]])), np.concatenate([b[hit], a[hit]])
            yield pa.RecordBatch.from_arrays([words.take(a), words.take(pa.array(b)), pa.array(n[b])], ["word", "other", "n"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 10 * BLOCK:
            continue
        # All but the last list, which may go on, are complete.
        table = pa.Table.from_batches(held)
        keys = [table.column(c).to_numpy() for c in ("list", "low", "high")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.argmax(last))
        if cut:
            yield from near(table.slice(0, cut))
        held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if size:
        yield from near(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, least: int = LEAST_LENGTH, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``(word, other, n)``: every two words of ``vocabulary (word, n)`` one edit apart, both ways, once; ``n`` is that of ``other``.

    All words have ``least`` letters or more. Lists longer than ``block`` are
    cut into blocks by a hash of the word, and every two blocks meet in a task
    of their own.
    """
    if least < 2 * SHORT:
        raise ValueError(f"words need {2 * SHORT} letters at least")
    spread = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_grams(vocabulary, share)
    rows = vocabulary.select("word", "n").mapInArrow(indexer(frequent, least), "list long, longer boolean, word string, n long")
    lists = stored(rows, "gram-lists", 10_000)
    # A word that is alone in its list meets nobody.
    sizes = stored(lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(
        "list", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "list-sizes")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("against")
    dealt = lists.join(sizes, "list").select("list", "longer", "word", "n", own, "blocks").select("*", others).select(
        "list", "longer", "word", "n", "block", F.least("block", "against").alias("low"), F.greatest("block", "against").alias("high"))
    keys = ["list", "low", "high"]
    met = dealt.repartition(spread, *keys).sortWithinPartitions(*keys)
    return met.mapInArrow(verifier, "word string, other string, n long").distinct()


def spelling_groups(
    counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """One row per word: ``(word, form, root, n, n_near, form_n)``.

    ``counts`` has a ``word`` and its number ``n``; rows that repeat a word are
    added up, NULL words and words below ``least_length`` code points or
    ``least_count`` occurrences are left out, other columns are ignored. Words
    are near if they differ by exactly one inserted, deleted or replaced code
    point. The ``form`` of a word is its near word with the largest count
    (ties: the first by code points), if that is ``ratio`` times the word's
    count at least, else NULL. ``root`` is where the forms lead; a word without
    a form is its own. ``n_near`` counts the near words. An empty table gives
    an empty table.
    """
    counted = counts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    vocabulary = stored(counted.where(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary, least_length, share, block)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("other").alias("other"))).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    form_n = -F.col("best.minus")
    strong = form_n >= ratio * F.col("n")
    formed = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, form_n).alias("form_n")), "forms")
    roots = follow(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(steps: DataFrame) -> DataFrame:
    """``(word, root)`` where each step ends that ``steps`` take one by one; counts grow along them, so there is an end.

    Every round doubles the steps taken. Counts grow by a factor with each
    step, so a handful of rounds is enough for any table.
    """
    reached = stored(steps, "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(reached.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        reached = moved.drop("moved")


def runs_of(text: Column, pattern: str) -> Column:
    """The maximal runs of ``pattern`` in a text, A-Z in lower case; none for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))


def word_counts(docs: DataFrame, pattern: str, text: str = "text", rewrite=None, keep: list[str] = ()) -> DataFrame:
    """``(word, n)`` over all whole texts; ``rewrite(word)`` may change each occurrence and use the columns ``keep``."""
    found = docs.select(*[F.col(f"`{c}`") for c in keep], F.explode(runs_of(F.col(f"`{text}`"), pattern)).alias("word"))
    word = F.col("word") if rewrite is None else rewrite(F.col("word"))
    return found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
