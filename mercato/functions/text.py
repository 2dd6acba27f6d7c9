"""String functions for ids, reviews and policy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense, with the four separator controls.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Remove white space of every kind, newlines too, from both ends."""
    return F.btrim(value, F.lit(BLANKS))


def normalize_category(value: Column) -> Column:
    """``Health Beauty`` → ``health_beauty``."""
    return F.replace(F.lower(value), F.lit(" "), F.lit("_"))


def remove_pattern(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def split_before(value: Column, header: str) -> Column:
    """Pieces of a text, each piece after the first starting with a header line."""
    return F.split(value, rf"\n(?={header})", -1)


def capture_first(value: Column, pattern: str) -> Column:
    """First group of the first match, or NULL.

    ``.`` stops at newlines only, and ``\\s`` is white space of every kind.
    """
    return F.nullif(F.regexp_extract(value, rf"(?dU){pattern}", 1), F.lit(""))


def review_text(title: Column, message: Column) -> Column:
    return strip(F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nMessage: "), message))


def with_parent(title: Column, chunk: Column) -> Column:
    return F.concat(F.lit("Parent Document: "), title, F.lit("\n\n"), chunk)


def enhanced_document(header: Column, summary: Column, chunk: Column) -> Column:
    return F.concat(
        F.lit("Title: "), header, F.lit("\nSummary: "), summary, F.lit("\n\nContent: \n"), chunk
    )


def first_line(value: Column) -> Column:
    return F.substring_index(value, "\n", 1)


def leading_sentences(value: Column, count: int = 2) -> Column:
    """The first sentences of a text, or all of it when it has no more."""
    return F.substring_index(F.replace(value, F.lit("\n"), F.lit(" ")), ". ", count)


def words(value: Column) -> Column:
    """Distinct lower-case words."""
    found = F.split(F.lower(value), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(found), "")
