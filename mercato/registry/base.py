"""Collecting queries and assembling their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named sub-queries, in an order in which each uses only earlier ones.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` may use any named part as a table."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return build

    return register


def with_parts(sql: str) -> str:
    """Put the parts that ``sql`` uses, directly or not, in front of it."""

    def uses(text: str) -> set[str]:
        return {name for name in PARTS if re.search(rf"\b{name}\b", text)}

    needed, todo = set(), uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= uses(PARTS[name]) - needed
    parts = ",\n".join(f"{name} AS (\n{PARTS[name]}\n)" for name in PARTS if name in needed)
    body = sql.strip()
    if not parts:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{parts},\n{body.removeprefix(start)}"
    return f"WITH {parts}\n{body}"
