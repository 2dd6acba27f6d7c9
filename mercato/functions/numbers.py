"""Arithmetic that must agree to the last digit, and number labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_sum(amount: Column) -> Column:
    """Sum in decimals, so that the order of addition cannot matter."""
    return F.sum(amount.cast("decimal(18,4)")).cast("double")


def money_avg(amount: Column) -> Column:
    return F.try_divide(money_sum(amount), F.count(amount))


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; NULL when ``whole`` is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole)


def volume(length: Column, height: Column, width: Column) -> Column:
    return length * height * width


def whole_part(value: Column) -> Column:
    """Drop the fraction; does not round."""
    return value.cast("bigint")


def percent_label(share: Column) -> Column:
    """0.4321 → ``43.2%``."""
    return F.concat(F.replace(F.format_number(share * 100, 1), F.lit(","), F.lit("")), F.lit("%"))


def dollar_label(amount: Column) -> Column:
    """1234.5 → ``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def units_label(amount: Column) -> Column:
    """12.7 → ``12 units``; NULL where there is no number."""
    return F.concat(amount.try_cast("bigint").cast("string"), F.lit(" units"))
