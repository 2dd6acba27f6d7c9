"""Running a query in Spark and its SQL twin in DuckDB, and comparing the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value both engines write the same way."""
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, build, sql: str, sf_dir: str) -> tuple[int, str]:
    """Number of Spark rows and a description of the first difference, if any."""
    df = build(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    types = {c[0]: str(c[1]) for c in found.description}
    right = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(left), f"columns {sorted(df.columns)} != {sorted(names)}"
    wide = [n for n, t in types.items() if t == "HUGEINT"]
    if wide:
        return len(left), f"HUGEINT columns {wide}"
    for field in df.schema.fields:
        spark_type, duck_type = field.dataType.simpleString(), types[field.name].upper()
        if spark_type in SAME and duck_type not in SAME[spark_type]:
            return len(left), f"type of {field.name}: {spark_type} != {duck_type}"
    if len(left) != len(right):
        return len(left), f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return len(left), f"{sorted(names)}\n  {a}\n  {b}"[:1500]
    return len(left), ""


SAME = {
    "int": {"INTEGER", "NUMBER"}, "bigint": {"BIGINT", "NUMBER"}, "double": {"DOUBLE", "NUMBER"},
    "string": {"VARCHAR", "STRING"}, "date": {"DATE", "DATETIME"}, "boolean": {"BOOLEAN", "BOOL"},
}
