"""Quality rules whose cutoffs come with a guarantee.

A rule rejects documents whose value reaches a cutoff. For every stratum and
rule the candidate cutoffs are tried from the mildest to the strictest. A
cutoff is accepted while an exact binomial test on the labelled holdout rejects
"more than ``risk / number of rules`` of the good documents would go"; the
first failure ends the sequence. The level of each sequence is ``error`` over
the number of strata and rules (Bonferroni; a fixed sequence needs no more).
So with probability ``1 - error``, in every stratum all rules together reject
at most ``risk`` of the good documents. Cutoffs do not depend on the data,
hence every label may serve as holdout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import BLANK_RUN, bind, keep_rows, stored, words
from mercato.llm.hypergeometric import ln_choose

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_marks"]
# Candidate cutoffs, mildest first. Each value is a share, of words or of lines.
CUTOFFS = {
    "symbols": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "marks": [1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_lines": [0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeats": [0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.05],
}


def values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n, "marks": F.col("n_marks") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / n,
    }


def occurrences(text: Column, characters: str) -> Column:
    return F.size(F.split(text, f"[{characters}]")) - 1


def repeated_words(found: Column) -> Column:
    """Words (an array) that lie in a window of 8 words found twice or more."""

    def window(w: Column, at: Column) -> Column:
        return F.slice(w, at + 1, WINDOW)

    def covered(w: Column, hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal(p: Column, a: Column, nth: Column) -> Column:
            b = F.get(p, nth)
            return F.coalesce((a["h"] == b["h"]) & (window(w, a["i"]) == window(w, b["i"])), F.lit(False))

        starts = bind(placed, lambda p: F.filter(p, lambda a, nth: equal(p, a, nth - 1) | equal(p, a, nth + 1)))
        ends = F.aggregate(
            F.sort_array(F.transform(starts, lambda a: a["i"])),
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
            lambda s, i: F.struct(
                (s["total"] + i + WINDOW - F.greatest(i, s["end"])).alias("total"), (i + WINDOW).alias("end")),
            lambda s: s["total"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ends).otherwise(0)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(window(w, i)))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(bind(hashes, lambda h: covered(w, h)))

    return bind(found, counted)


def features(text: Column) -> Column:
    """A struct of the counts of ``COUNTS`` and ``EXTRA``; all zero for NULL."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_line = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return bind(words(whole), lambda w: bind(per_line, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(whole, BLANK_RUN, "")).cast("long").alias("word_chars"),
        occurrences(whole, "#*$%&|<>").cast("long").alias("n_symbols"),
        x["dup"].cast("long").alias("n_dup_lines"), repeated_words(w).cast("long").alias("n_repeat_words"),
        x["n"].cast("long").alias("n_lines"), occurrences(whole, "!").cast("long").alias("n_marks"))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def stratum(value: Column) -> Column:
    """The stratum as text; NULL is one of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def tail(n: Column, k: Column, share: float) -> Column:
    """P(at most ``k`` of ``n``) when each counts with probability ``share``, exactly summed; 1 from the mean on."""
    n, k = n.cast("double"), k.cast("double")
    last = F.exp(ln_choose(n, k) + k * math.log(share) + (n - k) * math.log1p(-share))
    start = F.struct(last.alias("term"), last.alias("total"))
    down = F.sequence(k.cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long"))
    ratio = (1 - share) / share

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n - i + 1) * ratio
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    total = F.aggregate(down, start, step, lambda s: s["total"])
    return F.when(k >= n * share, 1.0).when(k == 0, last).otherwise(total)


def calibrate(found: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """All tests, ``(stratum, rule, step, cutoff, n, k, p, accepted)``; a rule's cutoff is its last accepted one.

    ``found`` has ``doc_id, stratum`` and the counts, ``labels`` ``doc_id,
    quality`` (1 is good; if an id is labelled twice, the better label holds;
    NULLs are left out). Documents that fail the base rules are not asked about.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    held = found.where(~base_failed()).join(good.select("doc_id"), "doc_id")
    exact = values()
    reached = [
        F.struct(
            F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"),
            F.sum((exact[rule] >= cut).cast("long")).alias("k"))
        for rule, cuts in CUTOFFS.items() for i, cut in enumerate(cuts)
    ]
    counted = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*reached).alias("tests"))
    counted = stored(counted, "holdout")
    level = error / (len(CUTOFFS) * max(1, counted.count()))
    tests = counted.select("stratum", "n", F.inline("tests")).withColumn("p", tail(F.col("n"), F.col("k"), risk / len(CUTOFFS)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    return tests.withColumn("accepted", F.min(F.col("p") <= level).over(so_far))


def cutoffs(tests: DataFrame) -> DataFrame:
    """``(stratum, <rule>...)``: the strictest accepted cutoff, NULL where there is none. One row per stratum."""
    chosen = [F.min(F.when((F.col("rule") == r) & F.col("accepted"), F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS]
    return stored(tests.groupBy("stratum").agg(*chosen), "cutoffs")


def judge(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """``found`` with ``base_failed, kept, rejected_by`` (names of the rules that a document fails)."""
    exact = values()
    failed = F.array(*[F.when(exact[r] >= F.col(f"cut_{r}"), F.lit(r)) for r in CUTOFFS])
    joined = found.join(chosen, "stratum", "left").withColumn("base_failed", base_failed())
    joined = joined.withColumn("rejected_by", F.array_compact(failed))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*[f"cut_{r}" for r in CUTOFFS])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", by: str = "lang") -> DataFrame:
    """``(doc_id, stratum, counts...)`` of every document, written once: some 60 bytes each, without texts."""
    rows = docs.select(F.col(key).alias("doc_id"), stratum(F.col(by)).alias("stratum"), features(F.col(text)).alias("f"))
    return stored(rows.select("doc_id", "stratum", "f.*"), "features")


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept``, ``rejected_by``.

    NULL and empty texts have no words and fail the base rules. Strata without
    enough labels get no cutoff: only the base rules reject there. Equal and
    repeated rows are judged alike, one row each; an empty table gives an empty
    table. Columns other than ``doc_id, text, lang`` are ignored.
    """
    found = measured(docs)
    chosen = cutoffs(calibrate(found, labels, risk, error))
    return judge(found, chosen).select("doc_id", *COUNTS, "base_failed", "kept", "rejected_by", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are counted once; the names of the rows that go are joined to the
    table. Rows that repeat id, text and language are judged alike.
    """
    rows = docs.select(
        F.col("doc_id"), F.xxhash64("text", "lang").alias("mark"), stratum(F.col("lang")).alias("stratum"), features(F.col("text")).alias("f"))
    found = stored(rows.select("doc_id", "mark", "stratum", "f.*"), "features")
    chosen = cutoffs(calibrate(found, labels, risk, error))
    return keep_rows(docs, judge(found, chosen).select("doc_id", "mark", "kept"), "doc_id", "text", "lang")
