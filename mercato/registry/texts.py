"""Queries over chunking, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato import schemas
from mercato.binding import bind, table
from mercato.functions import scores
from mercato.ml import embed
from mercato.operators import ann, knn, lexical, sampling
from mercato.plans import chunking, evaluation, retrieval, summary
from mercato.plans.delivery import is_delivered
from mercato.registry.base import part, query

# Patterns that occur in the supplied texts, in place of the policy patterns.
FOOTER = r"Licensed under the [A-Za-z]+ License, Version \d+"
HEADER = "[A-M]"
TITLE = r"(?:The|Le|La|Die|El) (.+)"

STRIPPED = r"regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '')"
SECTIONS = rf"""
SELECT doc_id, nth AS section, {STRIPPED} AS text FROM (
  SELECT doc_id, unnest(generate_series(0, len(pieces) - 1)) AS nth, unnest(pieces) AS piece FROM (
    SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n([A-M])', chr(57344) || '\1', 'g'), chr(57344)) AS pieces FROM %s))
WHERE length({STRIPPED}) >= 50
"""
TITLED = r"""
SELECT *, coalesce(last_value(own_title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Corporate_Policy') AS title FROM (
  SELECT *, nullif(regexp_replace(regexp_extract(text, '(?:The|Le|La|Die|El) (.+)', 1), '\s+$', ''), '') AS own_title
  FROM %s)
"""
part("whole_docs", r"""
SELECT conv_id AS doc_id, string_agg(regexp_replace(text, 'Licensed under the [A-Za-z]+ License, Version \d+', '', 'g') || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
part("clean_docs", r"""
SELECT doc_id, regexp_replace(text, 'Licensed under the [A-Za-z]+ License, Version \d+', '', 'g') AS text FROM documents
""")
part("page_sections", SECTIONS % "whole_docs")
part("doc_sections", SECTIONS % "clean_docs")
part("page_titles", TITLED % "page_sections")
part("doc_titles", TITLED % "doc_sections")
CHUNKS = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS chunk_no, title,
       CASE WHEN own_title IS NOT NULL THEN text ELSE 'Parent Document: ' || title || chr(10) || chr(10) || text END AS text
FROM {}
"""


def conversation_pages(spark, d):
    """Each conversation as a document, each turn as a page."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


def document_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit(0).cast("bigint").alias("page_no"), "text")


@query("src_text_docs", """
SELECT conv_id AS doc_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def src_text_docs(spark, d):
    return chunking.src_text_docs(conversation_pages(spark, d))


@query("title_carry_forward", "SELECT doc_id, section, own_title, title FROM page_titles")
def title_carry_forward(spark, d):
    pages = conversation_pages(spark, d)
    found = chunking.titled_sections(pages, FOOTER, HEADER, TITLE, chunking.MIN_LENGTH)
    return chunking.title_carry_forward(found).select("doc_id", "section", "own_title", "title")


@query("chunk_documents", CHUNKS.format("doc_titles"))
def chunk_documents(spark, d):
    return chunking.chunk_documents(document_pages(spark, d), FOOTER, HEADER, TITLE)


@query("chunk_pages", CHUNKS.format("page_titles"))
def chunk_pages(spark, d):
    return chunking.chunk_documents(conversation_pages(spark, d), FOOTER, HEADER, TITLE)


@query("chunk_header_summary", """
SELECT doc_id, text, header, summary,
       'Title: ' || header || chr(10) || 'Summary: ' || summary || chr(10) || chr(10) || 'Content: ' || chr(10) || text AS document
FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS header,
             array_to_string(string_split(replace(text, chr(10), ' '), '. ')[1:2], '. ') AS summary FROM documents)
""")
def chunk_header_summary(spark, d):
    return chunking.chunk_header_summary(table(spark, d, "documents").select("doc_id", "text"))


@query("chunk_central_summary")
def chunk_central_summary(spark, d):
    """Every document with its two central sentences."""
    return summary.central_summary(table(spark, d, "documents").select("doc_id", "text"))


@query("prepare_reviews", """
SELECT 'doc_' || (row_number() OVER (ORDER BY review_id) - 1) AS id,
       'Title: ' || coalesce(review_comment_title, '') || chr(10) || 'Message: ' || review_comment_message AS text,
       review_score AS score, CAST(review_id AS VARCHAR) AS review_id
FROM r_reviews WHERE review_comment_message IS NOT NULL
""")
def prepare_reviews(spark, d):
    return chunking.prepare_reviews(bind(spark, d).order_reviews)


part("distances", """
SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
       pow(array_distance(CAST(q.embedding AS DOUBLE[64]), CAST(c.embedding AS DOUBLE[64])), 2) AS d2
FROM embeddings q, embeddings c
""")


def vectors(spark, d, name):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(name), "embedding")


NEAREST = """
SELECT query_id, doc_id, round(d2, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, doc_id) AS rank FROM distances) WHERE rank <= {}
"""


@query("knn_topk", NEAREST.format(5))
def knn_topk(spark, d):
    """The nearest vectors of every vector."""
    hits = knn.knn_topk(vectors(spark, d, "query_id"), vectors(spark, d, "doc_id"), ["query_id"], "doc_id", 5)
    return hits.withColumn("dist", F.round("dist", 6))


@query("cross_vectors", NEAREST.format(10))
def cross_vectors(spark, d):
    """Every vector against every other, by the join made for large query sets."""
    hits = knn.knn_topk(vectors(spark, d, "query_id"), vectors(spark, d, "doc_id"), ["query_id"], "doc_id", 10)
    return hits.withColumn("dist", F.round("dist", 6))


@query("knn_approx")
def knn_approx(spark, d):
    """About the nearest vectors of every fiftieth vector, by codes."""
    index = ann.build_index(vectors(spark, d, "doc_id"), "doc_id")
    asked = vectors(spark, d, "query_id").where("query_id % 50 = 0")
    return ann.knn_approx(asked, index, ["query_id"]).withColumn("dist", F.round("dist", 6))


@query("knn_approx_recall", """
SELECT count(*) * least(10, (SELECT count(*) FROM embeddings)) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0
""")
def knn_approx_recall(spark, d):
    """Whether nine of ten neighbours that the exact search finds are found by codes too."""
    asked = vectors(spark, d, "query_id").where("query_id % 50 = 0")
    exact = knn.knn_topk(asked, vectors(spark, d, "doc_id"), ["query_id"], "doc_id", 10)
    return ann.recall(knn_approx(spark, d), exact, ["query_id"], "doc_id").select("wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough"))


# Each vector is a question; the two vectors after it are its reworded variants.
part("variant_hits", """
SELECT q.query_id, v.variant, e.doc_id, e.d2,
       row_number() OVER (PARTITION BY q.query_id, v.variant ORDER BY e.d2, e.doc_id) AS rank
FROM (SELECT vec_id AS query_id FROM embeddings) q, (VALUES (0), (1), (2)) v(variant), distances e
WHERE e.query_id = q.query_id + v.variant
""")
part("first_hits", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, rank, doc_id) - 1 AS seen FROM (
  SELECT * FROM variant_hits WHERE rank <= 5
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY variant, rank) = 1)
""")


def retrieved(spark, d):
    wanted = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("variant")
    )
    asked = wanted.withColumn("wording", F.col("query_id") + F.col("variant"))
    return retrieval.retrieve_dedupe(asked, vectors(spark, d, "doc_id"), wordings=vectors(spark, d, "wording"))


@query("retrieve_dedupe", """
SELECT query_id, doc_id, variant, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS dist, CAST(seen AS INTEGER) AS seen FROM first_hits
""")
def retrieve_dedupe(spark, d):
    return retrieved(spark, d).withColumn("dist", F.round("dist", 6))


@query("dedupe_first_seen", """
SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seen FROM (
  SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
""")
def dedupe_first_seen(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return sampling.dedupe_first_seen(events, "user_id", "event_type", ["event_id"])


part("doc_words", r"""
SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS words FROM documents
""")
part("lexical", """
SELECT query_id, h.doc_id, seen, coalesce(CAST(floor(CAST(len(list_intersect(q.words, c.words)) * 10 AS DOUBLE) / nullif(len(q.words), 0)) AS INTEGER), 0) AS score
FROM first_hits h JOIN doc_words q ON q.doc_id = query_id JOIN doc_words c ON c.doc_id = h.doc_id
""")
part("by_score", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS position FROM lexical")


def questions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def scored(spark, d):
    candidates = retrieved(spark, d).select("query_id", "doc_id", "seen")
    return retrieval.lexical_scores(candidates, questions(spark, d), table(spark, d, "documents"))


RANKED = ["query_id", "doc_id", "seen", "score", "position"]
RANKED_SQL = "SELECT query_id, doc_id, CAST(seen AS INTEGER) AS seen, score, CAST(position AS INTEGER) AS position FROM by_score WHERE position <= 5"


@query("rerank_topk", RANKED_SQL)
def rerank_topk(spark, d):
    return retrieval.rerank(scored(spark, d), above=-1).select(*RANKED)


@query("score_threshold", RANKED_SQL + " AND score > 3")
def score_threshold(spark, d):
    return retrieval.score_threshold(rerank_topk(spark, d)).select(*RANKED)


# One score reply per question; the questions of one label get an unreadable one.
part("replies", """
SELECT vec_id AS query_id, CASE WHEN label = 3 THEN 'no scores' ELSE label || ', 9,2, 5,' || label || ',4,8' END AS reply FROM embeddings
""")
part("zipped", """
SELECT h.query_id, doc_id, seen, reply = 'no scores' AS failed,
       CASE WHEN reply <> 'no scores' THEN CAST(trim(string_split(reply, ',')[seen + 1]) AS INTEGER) END AS score
FROM first_hits h JOIN replies r ON h.query_id = r.query_id WHERE reply = 'no scores' OR seen < 7
""")


def zipped(spark, d):
    label = F.col("label").cast("string")
    reply = F.when(F.col("label") == 3, "no scores").otherwise(F.concat(label, F.lit(", 9,2, 5,"), label, F.lit(",4,8")))
    replies = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), reply.alias("reply"))
    return retrieval.zip_scores(retrieved(spark, d).select("query_id", "doc_id", "seen"), replies)


@query("arr_zip_truncate", "SELECT query_id, doc_id, CAST(seen AS INTEGER) AS seen, failed, score FROM zipped")
def arr_zip_truncate(spark, d):
    return zipped(spark, d)


part("best", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE -score END, seen) AS position FROM zipped)
WHERE position <= 5 AND (failed OR score > 3)
""")


@query("rerank", "SELECT query_id, doc_id, CAST(seen AS INTEGER) AS seen, failed, score, CAST(position AS INTEGER) AS position FROM best")
def rerank(spark, d):
    return retrieval.rerank(zipped(spark, d))


@query("build_context", """
SELECT query_id, string_agg('--- Document Excerpt ' || nth || ' ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY position) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS nth FROM best JOIN documents USING (doc_id))
GROUP BY query_id
""")
def build_context(spark, d):
    texts = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.build_context(rerank(spark, d).join(texts, "doc_id"))


@query("str_context", """
SELECT order_id AS query_id, string_agg('--- Review ' || nth || ' (Rating: ' || review_score || ' stars) ---' || chr(10) ||
       review_comment_message || chr(10) || chr(10), '' ORDER BY review_id) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_id) AS nth FROM r_reviews WHERE review_comment_message IS NOT NULL)
GROUP BY order_id
""")
def str_context(spark, d):
    """The reviews of each order as the context of a question about it."""
    best = bind(spark, d).order_reviews.dropna(subset=["review_comment_message"]).select(
        F.col("order_id").alias("query_id"), F.col("review_id").alias("position"),
        F.col("review_score").alias("stars"), F.col("review_comment_message").alias("text"),
    )
    return retrieval.build_context(best, reviews=True)


@query("plain_context", """
SELECT c_custkey AS query_id, coalesce(string_agg(order_status || ' ' || order_id, chr(10) ORDER BY order_id),
       'NO CONTEXT FOUND') AS context
FROM customer LEFT JOIN r_orders ON c_custkey = customer_id GROUP BY 1
""")
def plain_context(spark, d):
    """The orders of each customer, one per line."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    best = bind(spark, d).orders.select(
        F.col("customer_id").alias("query_id"), F.col("order_id").alias("position"),
        F.concat_ws(" ", "order_status", "order_id").alias("text"))
    return retrieval.plain_context(asked, best)


@query("retrieval_status", """
SELECT query_id, found, kept, CASE WHEN found = 0 THEN 'no_candidates' WHEN kept = 0 THEN 'not_relevant' ELSE 'ok' END AS status,
       CASE WHEN found = 0 THEN 'No relevant information found in orders for this query.'
            WHEN kept = 0 THEN 'Information was found, but it was evaluated as not relevant to your specific question.' END AS message
FROM (SELECT c_custkey AS query_id, count(order_id) AS found, count(order_id) FILTER (order_status = 'delivered') AS kept
      FROM customer LEFT JOIN r_orders ON c_custkey = customer_id GROUP BY 1)
""")
def retrieval_status(spark, d):
    """Customers as questions, their orders as candidates, delivered ones as relevant."""
    r = bind(spark, d)
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    candidates = r.orders.select(F.col("customer_id").alias("query_id"), "order_status")
    return retrieval.retrieval_status(asked, candidates, candidates.where(is_delivered()), "orders")


@query("union_query_variants", r"""
SELECT query_id, CAST(unnest(generate_series(0, len(v) - 1)) AS INTEGER) AS variant, unnest(v) AS query FROM (
  SELECT conv_id || '-' || turn AS query_id, list_concat([text], list_filter(list_transform(string_split(text, chr(10)),
         lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')) AS v FROM conversations)
""")
def union_query_variants(spark, d):
    """The lines of each turn as variants of the whole."""
    rows = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.col("text").alias("query"), F.split("text", "\n").alias("variants"),
    )
    return retrieval.union_query_variants(rows)


part("user_tokens", """
SELECT query_id, pos, token FROM (
  SELECT conv_id || '-' || turn AS query_id, unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS pos,
         unnest(string_split(text, ' ')) AS token FROM conversations WHERE role = 'user')
""")


@query("expand_queries", """
SELECT conv_id || '-' || turn AS query_id, 0 AS variant, text AS query FROM conversations WHERE role = 'user'
UNION ALL
SELECT query_id, 1, string_agg(CASE WHEN length(token) >= 8 THEN reverse(token) ELSE token END, ' ' ORDER BY pos)
FROM user_tokens GROUP BY query_id HAVING max(length(token)) >= 8
UNION ALL
SELECT query_id, 2, string_agg(CASE WHEN length(token) >= 10 THEN token || 's' ELSE token END, ' ' ORDER BY pos)
FROM user_tokens GROUP BY query_id HAVING max(length(token)) >= 10
""")
def expand_queries(spark, d):
    """User turns; long words have a synonym, very long ones two."""
    asked = table(spark, d, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")
    )
    terms = asked.select(F.explode(F.split("query", " ")).alias("term")).distinct()
    synonyms = terms.where(F.length("term") >= 8).select(
        "term", F.lit(1).alias("variant"), F.reverse("term").alias("replacement")
    ).unionByName(terms.where(F.length("term") >= 10).select(
        "term", F.lit(2).alias("variant"), F.concat("term", F.lit("s")).alias("replacement")
    ))
    return retrieval.expand_queries(asked, synonyms)


WORDS_SQL = r"unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))"
part("bm25_tf", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {WORDS_SQL} AS term FROM documents) GROUP BY 1, 2")
part("bm25_lengths", "SELECT doc_id, sum(tf) AS length FROM bm25_tf GROUP BY 1")
part("bm25_df", "SELECT term, count(*) AS df FROM bm25_tf GROUP BY 1")
part("bm25_postings", f"""
SELECT doc_id, term, CAST(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
       * (tf * {lexical.K1 + 1}::DOUBLE / (tf + {lexical.K1}::DOUBLE * ({1 - lexical.B}::DOUBLE + {lexical.B}::DOUBLE * length / mean))) * 1e9::DOUBLE) AS BIGINT) AS impact
FROM bm25_tf JOIN bm25_lengths USING (doc_id) JOIN bm25_df USING (term),
     (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean FROM bm25_lengths)
""")


def text_index(spark, d):
    return lexical.build_index(table(spark, d, "documents"))


@query("rerank_bm25", """
SELECT query_id, doc_id, CAST(seen AS INTEGER) AS seen, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS position FROM (
    SELECT h.query_id, h.doc_id, seen, coalesce(CAST(sum(impact) AS BIGINT), 0) / 1e9::DOUBLE AS score
    FROM first_hits h LEFT JOIN bm25_tf q ON q.doc_id = h.query_id LEFT JOIN bm25_postings p ON p.doc_id = h.doc_id AND p.term = q.term
    GROUP BY 1, 2, 3))
WHERE position <= 5
""")
def rerank_bm25(spark, d):
    """The retrieved texts by their BM25 score for the whole text of the question."""
    candidates = retrieved(spark, d).select("query_id", "doc_id", "seen")
    scored = lexical.bm25_scores(candidates, questions(spark, d), text_index(spark, d))
    return retrieval.rerank(scored, above=-1).select("query_id", "doc_id", "seen", F.round("score", 6).alias("score"), "position")


part("asked", "SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'")
part("asked_terms", f"SELECT DISTINCT query_id, term FROM (SELECT query_id, {WORDS_SQL} AS term FROM asked)")
part("bm25_hits", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, CAST(sum(impact) AS BIGINT) / 1e9::DOUBLE AS score FROM asked_terms JOIN bm25_postings USING (term) GROUP BY 1, 2)
QUALIFY rank <= 5
""")
part("feedback", """
SELECT query_id, string_agg(term, ' ' ORDER BY place) AS added FROM (
  SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY sum(impact) DESC, term) AS place
  FROM bm25_hits JOIN bm25_postings USING (doc_id) ANTI JOIN asked_terms USING (query_id, term) GROUP BY 1, 2)
WHERE place <= 6 GROUP BY 1
""")


def user_turns(spark, d):
    return table(spark, d, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


@query("search_bm25", "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25_hits")
def search_bm25(spark, d):
    """The five best documents for every user turn."""
    return lexical.search(user_turns(spark, d), text_index(spark, d), 5).withColumn("score", F.round("score", 6))


@query("expand_feedback", """
SELECT query_id, 0 AS variant, text AS query FROM asked
UNION ALL SELECT query_id, 1, text || ' ' || added FROM asked JOIN feedback USING (query_id)
UNION ALL SELECT query_id, 2, added FROM asked JOIN feedback USING (query_id)
""")
def expand_feedback(spark, d):
    """User turns with two variants each, from the terms of their first hits."""
    return lexical.feedback_variants(user_turns(spark, d), text_index(spark, d))


@query("embed_text")
def embed_text(spark, d):
    corpus = table(spark, d, "documents").select("doc_id", "text")
    return embed.embed_text(embed.fit_embedder(corpus), corpus).select("doc_id", "embedding")


@query("retrieve_text")
def retrieve_text(spark, d):
    """Documents nearest to each benchmark text, by embedded words."""
    corpus = table(spark, d, "documents").select("doc_id", "text")
    model = embed.fit_embedder(corpus)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), "text")
    return retrieval.retrieve_dedupe(
        embed.embed_text(model, asked).drop("text"), embed.embed_text(model, corpus).drop("text")
    )


@query("sample_eval_cases", """
SELECT lang AS collection, doc_id, text, CAST(NULL AS VARCHAR) AS query, CAST(NULL AS VARCHAR) AS expected_ground_truth FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 24
UNION ALL SELECT 'corporate_policies', NULL, NULL, 'What is the CEO''s favorite color?', 'OUT_OF_BOUNDS_FALLBACK'
UNION ALL SELECT 'customer_reviews', NULL, NULL, 'Can you show me the server password logs?', 'OUT_OF_BOUNDS_FALLBACK'
""")
def sample_eval_cases(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("collection"), "doc_id", "text")
    return evaluation.sample_eval_cases(docs)


@query("union_trap_cases", """
SELECT text AS query, lang AS collection, source AS expected_ground_truth FROM documents
UNION ALL SELECT 'What is the CEO''s favorite color?', 'corporate_policies', 'OUT_OF_BOUNDS_FALLBACK'
UNION ALL SELECT 'Can you show me the server password logs?', 'customer_reviews', 'OUT_OF_BOUNDS_FALLBACK'
""")
def union_trap_cases(spark, d):
    return evaluation.union_trap_cases(table(spark, d, "documents").select(
        F.col("text").alias("query"), F.col("lang").alias("collection"), F.col("source").alias("expected_ground_truth")
    ))


# One evaluated case per document (FIXTURES.md); cases in Spanish failed.
part("cases", """
SELECT doc_id AS id, text AS query, source AS collection,
       CASE WHEN doc_id % 25 = 0 THEN 'OUT_OF_BOUNDS_FALLBACK' ELSE lang END AS expected_ground_truth,
       CASE WHEN doc_id % 50 = 0 THEN 'No relevant information found in ' || source ELSE text END AS generated_answer,
       CAST(doc_id % 4 AS INTEGER) AS n_chunks,
       CASE WHEN lang <> 'es' THEN CAST(1 + doc_id % 10 AS INTEGER) END AS context_relevance,
       CASE WHEN lang <> 'es' THEN CAST(1 + (doc_id * 3) % 10 AS INTEGER) END AS faithfulness,
       CASE WHEN lang <> 'es' THEN CAST(1 + (doc_id * 7) % 10 AS INTEGER) END AS answer_relevance
FROM documents
""")
part("guarded", """
SELECT *, CASE WHEN expected_ground_truth <> 'OUT_OF_BOUNDS_FALLBACK' THEN 'N/A'
               WHEN contains(generated_answer, 'No relevant information found') OR n_chunks = 0 THEN 'PASSED' ELSE 'FAILED' END AS fallback_status
FROM cases
""")


def cases(spark, d):
    doc = F.col("doc_id")
    judged = F.col("lang") != "es"
    return table(spark, d, "documents").select(
        doc.alias("id"),
        F.col("text").alias("query"),
        F.col("source").alias("collection"),
        F.when(doc % 25 == 0, evaluation.TRAP).otherwise(F.col("lang")).alias("expected_ground_truth"),
        F.when(doc % 50 == 0, F.concat(F.lit("No relevant information found in "), "source"))
        .otherwise(F.col("text")).alias("generated_answer"),
        (doc % 4).cast("int").alias("n_chunks"),
        *[
            F.when(judged, (1 + (doc * k) % 10).cast("int")).alias(name)
            for name, k in zip(evaluation.SCORES, (1, 3, 7))
        ],
    )


@query("guardrail_status", "SELECT id, expected_ground_truth, n_chunks, fallback_status FROM guarded")
def guardrail_status(spark, d):
    return evaluation.guardrail_status(cases(spark, d)).select(
        "id", "expected_ground_truth", "n_chunks", "fallback_status"
    )


@query("eval_summary", """
SELECT count(*) AS total_test_cases, CAST(sum(context_relevance) AS DOUBLE) / count(*) AS avg_context_relevance,
       CAST(sum(faithfulness) AS DOUBLE) / count(*) AS avg_faithfulness,
       CAST(sum(answer_relevance) AS DOUBLE) / count(*) AS avg_answer_relevance,
       count(*) FILTER (fallback_status = 'PASSED' AND faithfulness IS NOT NULL)
       / count(*) FILTER (fallback_status <> 'N/A' AND faithfulness IS NOT NULL) * 100 AS guardrail_accuracy
FROM guarded
""")
def eval_summary(spark, d):
    return evaluation.eval_summary(evaluation.guardrail_status(cases(spark, d)))


@query("eval_report", """
SELECT id, TIMESTAMP '2026-06-17 21:43:20' AS timestamp, query, collection, expected_ground_truth, generated_answer, context_relevance,
       faithfulness, answer_relevance, fallback_status, collection AS reasoning FROM guarded WHERE context_relevance IS NOT NULL
""")
def eval_report(spark, d):
    """Cases joined with judge replies; failed cases have none."""
    return evaluation.eval_report(*asked_and_judged(spark, d), RUN_TIME)


@query("eval_run", """
SELECT TIMESTAMP '2026-06-17 21:43:20' AS execution_time, count(*) AS total_test_cases,
       CAST(sum(context_relevance) AS DOUBLE) / count(*) AS avg_context_relevance,
       CAST(sum(faithfulness) AS DOUBLE) / count(*) AS avg_faithfulness,
       CAST(sum(answer_relevance) AS DOUBLE) / count(*) AS avg_answer_relevance,
       count(*) FILTER (fallback_status = 'PASSED' AND faithfulness IS NOT NULL)
       / count(*) FILTER (fallback_status <> 'N/A' AND faithfulness IS NOT NULL) * 100 AS guardrail_accuracy
FROM guarded
""")
def eval_run(spark, d):
    """A run from cases and raw replies to the history, which was empty before."""
    history = spark.createDataFrame([], schemas.RUN_HISTORY)
    return evaluation.eval_run(*asked_and_judged(spark, d), history, RUN_TIME)[1]


def asked_and_judged(spark, d):
    rows = cases(spark, d)
    reply = F.to_json(F.struct(*evaluation.SCORES, F.col("collection").alias("reasoning")))
    replies = rows.dropna(subset=evaluation.SCORES).select("id", scores.parse_judge_reply(reply).alias("judge"))
    return rows.drop(*evaluation.SCORES), replies


RUN_TIME = "2026-06-17 21:43:20"
