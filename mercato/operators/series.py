"""Weekly time series: dense spines, lags and exponential averages.

All of it works on rows already summed per series and week, so a series has
at most as many rows as there are weeks between its first and last sale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions import dates


def weekly_resample(daily: DataFrame, key: str, day: str, sums: dict[str, Column], week: str) -> DataFrame:
    """Weekly aggregates per series in weeks ending on Sunday; weeks without rows are 0.

    ``sums`` maps output names to aggregates. Each week with rows is stretched
    up to the next one of its series, which fills the gaps without a join.
    Rows without a day belong to no week.
    """
    start, following = "_start", "_next"
    by_week = Window.partitionBy(key).orderBy(start)
    summed = daily.where(F.col(day).isNotNull()).groupBy(key, dates.week_ending(F.col(day)).alias(start)).agg(
        *[total.alias(out) for out, total in sums.items()]
    )
    last = F.coalesce(F.date_sub(F.col(following), 7), F.col(start))
    real = F.col(week) == F.col(start)
    return (
        summed.withColumn(following, F.lead(start).over(by_week))
        .withColumn(week, F.explode_outer(F.sequence(F.col(start), last, F.expr("interval 7 days"))))
        .select(key, week, *[F.when(real, F.col(c)).otherwise(F.lit(0)).alias(c) for c in sums])
    )


def lag_features(weekly: DataFrame, key: str, week: str, lags: dict[str, str]) -> DataFrame:
    """Add last week's value of each column in ``lags`` (input → output)."""
    order = Window.partitionBy(key).orderBy(week)
    return weekly.withColumns({out: F.lag(source, 1).over(order) for source, out in lags.items()})


# Points folded into one short array at a time.
FOLD = 64


def ewma_state(weekly: DataFrame, key: str, week: str, averages: dict[str, str], span: int = 4) -> DataFrame:
    """Add the exponential average of each column in ``averages``, this week included.

    With ``alpha = 2 / (span + 1)``: the first value as it is, then
    ``(1 - alpha) * previous + alpha * value``. Growing an array copies it, so
    the fold runs over short pieces of a series and collects the pieces.
    """
    alpha = 2.0 / (span + 1)
    carried = [c for c in weekly.columns if c != key]
    types = {f.name: f.dataType.simpleString() for f in weekly.schema.fields}
    fields = [f"`{c}`: {types[c]}" for c in carried] + [f"`{out}`: double" for out in averages.values()]
    row_type = f"struct<{', '.join(fields)}>"
    points = F.array_sort(F.collect_list(F.struct(week, *[c for c in carried if c != week])))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_points") - 1) / FOLD).cast("int")),
        lambda i: F.slice(F.col("_points"), i * FOLD + 1, F.lit(FOLD)),
    )

    def fold(done: Column, piece: Column) -> Column:
        def step(part: Column, point: Column) -> Column:
            before = F.coalesce(
                F.try_element_at(part, F.lit(-1)), F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1))
            )
            smoothed = [
                F.coalesce(before[out] * (1 - alpha) + point[c].cast("double") * alpha, point[c].cast("double")).alias(out)
                for c, out in averages.items()
            ]
            return F.concat(part, F.array(F.struct(*[point[c].alias(c) for c in carried], *smoothed)))

        return F.concat(done, F.array(F.aggregate(piece, F.array().cast(f"array<{row_type}>"), step)))

    folded = F.aggregate(pieces, F.array().cast(f"array<array<{row_type}>>"), fold)
    # inline_outer: plain inline adds filters on the array and so folds it three times.
    return (
        weekly.groupBy(key)
        .agg(points.alias("_points"))
        .select(key, F.inline_outer(F.flatten(folded)))
        .select(*weekly.columns, *averages.values())
    )


def latest_state(weekly: DataFrame, key: str, week: str) -> DataFrame:
    """The last week of each series."""
    others = [c for c in weekly.columns if c != key]
    last = F.max_by(F.struct(*others), F.col(week)).alias("_last")
    return weekly.groupBy(key).agg(last).select(key, "_last.*").select(*weekly.columns)


def time_cutoff(df: DataFrame, week: str, holdout_weeks: int = 8):
    """The first week of the test part, as a scalar."""
    return df.agg(F.date_sub(F.max(week), 7 * holdout_weeks)).scalar()


def time_cutoff_split(df: DataFrame, week: str, holdout_weeks: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and rows from it on."""
    cutoff = time_cutoff(df, week, holdout_weeks)
    return df.where(F.col(week) < cutoff), df.where(F.col(week) >= cutoff)
