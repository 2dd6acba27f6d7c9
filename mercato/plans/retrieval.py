"""Batch retrieval: query variants, first-seen chunks, reranking, context and status."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import scores, text
from mercato.operators import knn, sampling
from mercato.sources.files import materialize

# Chunks per search, chunks kept, and the score a kept chunk must exceed.
CHUNKS_PER_QUERY = 5
TOP_K = 5
SCORE_ABOVE = 3

# Candidates whose texts go to one task.
PAIRS = 1 << 16

# The answers when there is nothing to answer from.
NOT_RELEVANT = "Information was found, but it was evaluated as not relevant to your specific question."
NO_CONTEXT = "NO CONTEXT FOUND"


def union_query_variants(queries: DataFrame) -> DataFrame:
    """``(query_id, variant, query)``: the query itself as 0, then its non-blank variants.

    Input: ``query_id, query, variants`` with an array of texts.
    """
    stripped = F.transform(F.coalesce("variants", F.array().cast("array<string>")), text.strip)
    filled = F.filter(stripped, lambda v: v != "")
    return queries.select(
        "query_id", F.posexplode_outer(F.concat(F.array("query"), filled)).alias("variant", "query")
    )


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Queries with a reworded variant per synonym set.

    ``synonyms`` has ``(term, variant, replacement)``, one row per term and
    variant from 1 on. A variant in which nothing is replaced is left out.
    """
    replaced = F.map_from_entries(F.collect_list(F.struct("variant", "replacement")))
    by_term = synonyms.groupBy("term").agg(replaced.alias("by_variant"))
    tokens = queries.select("query_id", F.posexplode_outer(F.split("query", " ")).alias("pos", "token"))
    in_order = F.array_sort(
        F.collect_list(F.struct("pos", "token", "by_variant")), lambda a, b: a["pos"] - b["pos"]
    )
    per_query = (
        tokens.join(by_term, F.col("token") == F.col("term"), "left")
        .groupBy("query_id")
        .agg(in_order.alias("tokens"))
    )
    known = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.map_keys(t["by_variant"]), F.array())))

    def reworded(t):
        return F.coalesce(F.try_element_at(t["by_variant"], F.col("variant")), t["token"])

    variants = (
        per_query.select("query_id", "tokens", F.explode(F.array_distinct(known)).alias("variant"))
        .select("query_id", "variant", F.array_join(F.transform("tokens", reworded), " ").alias("query"))
    )
    return queries.select("query_id", F.lit(0).alias("variant"), "query").unionByName(variants)


def retrieve_dedupe(
    queries: DataFrame, corpus: DataFrame, chunks_per_query: int = CHUNKS_PER_QUERY, wordings: DataFrame | None = None
) -> DataFrame:
    """Nearest chunks of every variant, each chunk once per query.

    ``queries``: ``(query_id, variant, embedding)``; ``corpus``: ``(doc_id, embedding)``.
    Queries that share wordings are ``(query_id, variant, wording)``, with one
    row ``(wording, embedding)`` per wording; each is then searched once.
    """
    if wordings is None:
        hits = knn.knn_topk(queries, corpus, ["query_id", "variant"], "doc_id", chunks_per_query)
    else:
        asked = wordings.join(queries.select("wording"), "wording", "left_semi")
        found = knn.knn_topk(asked, corpus, ["wording"], "doc_id", chunks_per_query)
        hits = queries.select("query_id", "variant", "wording").join(found, "wording").drop("wording")
    return sampling.dedupe_first_seen(hits, "query_id", "doc_id", ["variant", "rank"])


def _word_lists(texts: DataFrame, key: str, wanted: DataFrame, out: str, parts: int, joined: bool = False) -> DataFrame:
    """``(key, out)``: the distinct words of the wanted texts, written once; ``joined`` by blanks, or as an array.

    Texts are dealt anew first, as the wanted ones may lie in few files; and
    words that are not written are found again for each row of a join.
    """
    kept = texts.join(wanted.select(key), key, "left_semi").repartition(parts, key)
    found = text.words(F.col(next(c for c in texts.columns if c != key)))
    return materialize(kept.select(key, (F.array_join(found, " ") if joined else found).alias(out)), "words")


def lexical_scores(candidates: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add ``score`` 0–10: the share of the query's words found in the chunk.

    Only texts that asked or were found are taken apart, each once. The words of
    a query go with each of its candidates to the texts, as one string: an array
    adds an offset and padding to each word.
    """
    candidates = materialize(candidates, "candidates")
    parts = max(4 * candidates.sparkSession.sparkContext.defaultParallelism, math.ceil(candidates.count() / PAIRS))
    asked = _word_lists(queries.select("query_id", "query"), "query_id", candidates, "_asked", parts, joined=True)
    found = _word_lists(corpus.select("doc_id", "text"), "doc_id", candidates, "_words", parts)
    return (
        candidates.join(asked, "query_id").join(found, "doc_id")
        .withColumn("_asked", F.array_remove(F.split("_asked", " "), ""))
        .withColumn("score", scores.lexical_score(F.col("_asked"), F.col("_words")))
        .drop("_asked", "_words")
    )


def zip_scores(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates with the score at their place in the reply.

    A reply that cannot be read marks all its candidates ``failed``; candidates
    beyond the end of a shorter reply drop out.
    """
    parsed = replies.select("query_id", scores.parse_scores(F.col("reply")).alias("scores"))
    joined = candidates.join(parsed, "query_id", "left").withColumns({
        "failed": F.col("scores").isNull(),
        "score": F.get("scores", F.col("seen")),
    })
    return joined.where(F.col("failed") | F.col("score").isNotNull()).drop("scores")


def rerank(scored: DataFrame, top_k: int = TOP_K, above: int = SCORE_ABOVE) -> DataFrame:
    """The ``top_k`` chunks by score, then only those above the threshold.

    Ties keep the first-seen order. Where scoring ``failed``, the first
    ``top_k`` chunks stay as they are.
    """
    if "failed" not in scored.columns:
        scored = scored.withColumn("failed", F.lit(False))
    by_score = F.when(F.col("failed"), F.lit(0)).otherwise(-F.col("score"))
    order = Window.partitionBy("query_id").orderBy(by_score, "seen")
    return (
        scored.withColumn("position", F.row_number().over(order))
        .where((F.col("position") <= top_k) & (F.col("failed") | (F.col("score") > above)))
    )


def score_threshold(ranked: DataFrame, top_k: int = TOP_K, above: int = SCORE_ABOVE) -> DataFrame:
    return ranked.where((F.col("position") <= top_k) & (F.col("score") > above))


def retrieval_status(queries: DataFrame, candidates: DataFrame, best: DataFrame, collection: str) -> DataFrame:
    """Per query: how many chunks were found and kept, and the message if none."""
    found = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    kept = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    counted = (
        queries.select("query_id").join(found, "query_id", "left").join(kept, "query_id", "left").na.fill(0)
    )
    none, poor = F.col("found") == 0, F.col("kept") == 0
    return counted.select(
        "query_id",
        "found",
        "kept",
        F.when(none, "no_candidates").when(poor, "not_relevant").otherwise("ok").alias("status"),
        F.when(none, f"No relevant information found in {collection} for this query.")
        .when(poor, NOT_RELEVANT)
        .alias("message"),
    )


def _numbered(best: DataFrame) -> DataFrame:
    """The chunks of each query, numbered from 1; ``rerank`` has cut them already."""
    return best.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))


def build_context(best: DataFrame, reviews: bool = False) -> DataFrame:
    """One context text per query: its chunks by position under numbered headings.

    ``best`` has ``(query_id, position, text)`` and, for reviews, ``stars``.
    """
    number = F.col("number").cast("string")
    excerpt = F.concat(F.lit("--- Document Excerpt "), number, F.lit(" ---\n"), "text", F.lit("\n\n"))
    if reviews:
        rated = F.concat(
            F.lit("--- Review "), number, F.lit(" (Rating: "), F.col("stars").cast("string"),
            F.lit(" stars) ---\n"), "text", F.lit("\n\n"),
        )
        excerpt = F.when(F.col("stars").isNotNull(), rated).otherwise(excerpt)
    ordered = F.array_sort(F.collect_list(F.struct("number", excerpt.alias("block"))))
    return _numbered(best).groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "").alias("context")
    )


def plain_context(queries: DataFrame, best: DataFrame) -> DataFrame:
    """Chunks by position, one per line, or the fixed text when there is none."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "text")))
    joined = _numbered(best).groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("context")
    )
    return queries.select("query_id").join(joined, "query_id", "left").na.fill({"context": NO_CONTEXT})
