"""Score lists and judge replies that come back as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.schemas import JUDGE_REPLY

# Fixed reply when a judge answer cannot be read.
UNREADABLE_SCORE = 1
UNREADABLE_REASON = "Failed to judge."


def parse_scores(reply: Column) -> Column:
    """``"8, 2,10"`` → ``[8, 2, 10]``; NULL when any item is not an integer."""
    items = F.transform(
        F.split(reply, ",", -1), lambda s: F.trim(s).try_cast("int")
    )
    return F.when(~F.exists(items, lambda s: s.isNull()), items)


def parse_judge_reply(reply: Column) -> Column:
    """Judge JSON → struct; fixed values where the reply or a field cannot be read.

    Scores may be written as 8 or as 8.0.
    """
    scores = [f for f in JUDGE_REPLY.fieldNames() if f != "reasoning"]
    schema = ", ".join(f"{f} double" for f in scores) + ", reasoning string, _unread string"
    parsed = F.from_json(reply, schema, {"columnNameOfCorruptRecord": "_unread"})
    readable = parsed.isNotNull() & parsed["_unread"].isNull()
    return F.struct(
        *[F.coalesce(F.when(readable, parsed[f].try_cast("int")), F.lit(UNREADABLE_SCORE)).alias(f) for f in scores],
        F.coalesce(F.when(readable, parsed["reasoning"]), F.lit(UNREADABLE_REASON)).alias("reasoning"),
    )


def lexical_score(query_words: Column, text_words: Column) -> Column:
    """Share of the query's words found in the text, as a whole number 0–10."""
    found = F.size(F.array_intersect(query_words, text_words))
    return F.coalesce(F.floor(F.try_divide(found * F.lit(10), F.size(query_words))), F.lit(0)).cast("int")
