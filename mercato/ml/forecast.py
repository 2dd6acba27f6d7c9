"""Next week's revenue and units per category."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions import dates, numbers, text
from mercato.ml import boosting
from mercato.ml.boosting import BoostedModel
from mercato.ml.trees import Settings
from mercato.plans.demand import KEY

# Size of the models, and the names a forecast can be asked by.
MODEL = Settings(trees=200, depth=5, step=0.05, l2=1.0, least_weight=1.0, loss="squared", seed=42)
UNIT_TYPES = ["inventory", "units", "stock"]
WRONG_TYPE = "Invalid forecast type. Use 'revenue' or 'inventory'."

REVENUE = ("weekly_revenue", ["year", "week_of_year", "lag_1_revenue", "ewma_4_revenue"])
UNITS = ("weekly_units", ["year", "week_of_year", "lag_1_units", "ewma_4_units"])


def train_forecaster(train: DataFrame, target: str, features: list[str], settings: Settings = MODEL) -> BoostedModel:
    """Boosted trees that start at the mean and split categories as sets.

    Categories are ordered by their gradients in every node, so a split may
    send any of them to either side. One not seen in training goes the way of
    missing values.
    """
    known = train.agg(F.round(F.avg(target), 4).alias("mean"), F.max(F.abs(F.col(target).cast("double"))).alias("most")).first()
    fitted = dataclasses.replace(settings, base=float(known["mean"] or 0.0), largest=2.0 * float(known["most"] or 1.0))
    return boosting.fit(train, target, features, [KEY], fitted)


def train_revenue_model(train: DataFrame, settings: Settings = MODEL) -> BoostedModel:
    return train_forecaster(train, *REVENUE, settings=settings)


def train_units_model(train: DataFrame, settings: Settings = MODEL) -> BoostedModel:
    return train_forecaster(train, *UNITS, settings=settings)


def predict(model: BoostedModel, rows: DataFrame, out: str) -> DataFrame:
    return rows.withColumn(out, model.margin())


def forecast_next_week(
    requests: DataFrame, next_week: DataFrame, revenue_model: BoostedModel, units_model: BoostedModel
) -> DataFrame:
    """Answers to ``(category, forecast_type)`` requests, all in one job.

    ``next_week`` holds one feature row per category. Both models see each
    category once, however many requests there are.
    """
    forecasts = predict(units_model, predict(revenue_model, next_week, "revenue"), "units").select(
        F.col(KEY).alias("known"), dates.iso_text(F.col("target_date")).alias("target_date"), "revenue", "units"
    )
    joined = requests.join(forecasts, text.normalize_category(F.col(KEY)) == F.col("known"), "left")
    known = F.col("known").isNotNull()
    revenue = F.col("forecast_type") == "revenue"
    units = F.col("forecast_type").isin(*UNIT_TYPES)
    answered = known & (revenue | units)
    unknown = F.concat(F.lit("Category "), KEY, F.lit(" not found in Historical Data."))
    return joined.select(
        KEY,
        "forecast_type",
        F.when(answered, "success").otherwise("error").alias("status"),
        F.when(answered, F.col("target_date")).alias("target_date"),
        F.when(answered & revenue, "Projected Revenue").when(answered, "Projected Unit Volume").alias("metric"),
        F.when(answered & revenue, numbers.dollar_label(F.col("revenue")))
        .when(answered, numbers.units_label(F.col("units")))
        .alias("value"),
        F.when(~known, unknown).when(~answered, WRONG_TYPE).alias("message"),
    )
