"""From document pages to titled chunks, and from reviews to texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions import text
from mercato.operators import sampling, scan
from mercato.sources.files import materialize

# What follows the company's name in a page footer, section headers,
# policy titles and the shortest chunk.
FOOTER_END = r" Internal Document - Strictly Confidential - Page \d+"
HEADER = r"(?U)(?:[1-9]\.0(?:\s|\z)|Policy ID:)"
TITLE = r"Title:\s*(.+)"
DEFAULT_TITLE = "Corporate_Policy"
MIN_LENGTH = 50


def footer_pattern(company: str) -> str:
    """The page footer of a company's documents."""
    return re.escape(company) + FOOTER_END


def page_number() -> Column:
    """The page number; an error where it is missing, as the page then has no place."""
    return F.coalesce("page_no", F.raise_error(F.lit("a page has no number")).cast("bigint"))


def src_text_docs(pages: DataFrame) -> DataFrame:
    """Whole text per document: its pages in order, a newline after each.

    The result of one document is one row; what has to scale works on pages.
    """
    ordered = F.array_sort(F.collect_list(F.struct(page_number().alias("page_no"), "text")))
    lines = F.transform(ordered, lambda page: F.concat(page["text"], F.lit("\n")))
    return pages.groupBy("doc_id").agg(F.array_join(lines, "").alias("text"))


def min_length_filter(chunks: DataFrame, column: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    return chunks.where(F.length(text.strip(F.col(column))) >= least)


def _cut(pages: DataFrame, footer: str, header: str) -> DataFrame:
    """Pages with their pieces; all but the first piece of a page start with a header."""
    body = F.concat(F.lit("\n"), text.remove_pattern(F.coalesce("text", F.lit("")), footer))
    return pages.select("doc_id", page_number().alias("page_no"), text.split_before(body, header).alias("pieces"))


def _numbered(pieces: str) -> Column:
    # There is always a piece. Unlike posexplode, this adds no filter on the
    # array, for which the patterns would be searched twice more.
    return F.posexplode_outer(pieces)


def sections(pages: DataFrame, footer: str, header: str) -> DataFrame:
    """Text between two headers, also when it runs over several pages.

    Pages are cut on their own. A running count of the headers on earlier
    pages numbers the sections, so no document is ever put together as a whole.
    """
    cut = _cut(pages, footer, header)
    headers = cut.select("doc_id", "page_no", (F.size("pieces") - 1).alias("headers"))
    upto = scan.running_total(headers, ["doc_id"], "page_no", "headers", "upto")
    pieces = (
        cut.join(upto.select("doc_id", "page_no", (F.col("upto") - F.col("headers")).alias("before")),
                 ["doc_id", "page_no"])
        .select("doc_id", "page_no", "before", _numbered("pieces").alias("nth", "piece"))
        .withColumn("section", F.col("before") + F.col("nth"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("page_no", "piece")))
    return pieces.groupBy("doc_id", "section").agg(
        F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("text")
    )


def titled_sections(pages: DataFrame, footer: str, header: str, title: str, min_length: int) -> DataFrame:
    """Stripped sections of some length with the title they carry themselves, if any."""
    clean = sections(pages, footer, header).withColumn("text", text.strip(F.col("text")))
    long_enough = clean.where(F.length("text") >= min_length)
    return long_enough.withColumn("own_title", text.strip(text.capture_first(F.col("text"), title)))


def title_carry_forward(found: DataFrame, default: str = DEFAULT_TITLE) -> DataFrame:
    """Add ``title``, the latest title up to and including the section, and ``chunk_no``.

    The sections are written to the shared folder first, as the blocked scans
    read their small columns several times.
    """
    found = materialize(found, "sections")
    slim = found.select("doc_id", "section", "own_title")
    carried = scan.carry_forward(slim, ["doc_id"], "section", "own_title", "title").drop("own_title")
    indexed = scan.dense_index(carried, ["doc_id"], "section", "chunk_no")
    return found.join(indexed, ["doc_id", "section"]).withColumn("title", F.coalesce("title", F.lit(default)))


def chunk_documents(
    pages: DataFrame, footer: str, header: str = HEADER, title: str = TITLE,
    default_title: str = DEFAULT_TITLE, min_length: int = MIN_LENGTH,
) -> DataFrame:
    """Chunks ``(doc_id, chunk_no, title, text)``; ``chunk_no`` counts from 0 per document.

    Short sections are dropped before titles are looked for. A chunk without a
    title of its own names its parent document first.
    """
    found = titled_sections(pages, footer, header, title, min_length)
    return title_carry_forward(found, default_title).select(
        "doc_id",
        "chunk_no",
        "title",
        F.when(F.col("own_title").isNotNull(), F.col("text"))
        .otherwise(text.with_parent(F.col("title"), F.col("text")))
        .alias("text"),
    )


def chunk_header_summary(chunks: DataFrame) -> DataFrame:
    """Add a header (first line) and a summary (two sentences) and put them before the text."""
    body = F.col("text")
    return chunks.withColumns({
        "header": text.first_line(body), "summary": text.leading_sentences(body),
    }).withColumn("document", text.enhanced_document(F.col("header"), F.col("summary"), body))


def prepare_reviews(reviews: DataFrame, order: str = "review_id") -> DataFrame:
    """All reviews with a message, as ``(id, text, score, review_id)``; see ``tail_sample`` for the last ones only."""
    with_text = reviews.dropna(subset=["review_comment_message"])
    numbered = scan.ordered_index(with_text, order, "_index")
    return sampling.row_ids(numbered, "doc_", "_index").select(
        "id",
        text.review_text(F.col("review_comment_title"), F.col("review_comment_message")).alias("text"),
        F.col("review_score").alias("score"),
        F.col("review_id").cast("string").alias("review_id"),
    )
