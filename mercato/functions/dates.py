"""Calendar functions over dates and zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(moment: Column) -> Column:
    return F.month(moment)


def day_of_week(moment: Column) -> Column:
    """1 = Sunday … 7 = Saturday."""
    return F.dayofweek(moment)


def calendar_days(end: Column, start: Column) -> Column:
    """Days between the calendar dates, whatever the time of day."""
    return F.datediff(end, start)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods from ``earlier`` to ``later``."""
    return F.extract(F.lit("DAY"), later - earlier)


def iso_year(moment: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), moment)


def iso_week(moment: Column) -> Column:
    return F.weekofyear(moment)


def week_ending(moment: Column) -> Column:
    """The Sunday that closes the week."""
    return F.date_add(F.date_trunc("week", moment).cast("date"), 6)


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
