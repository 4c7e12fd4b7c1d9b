"""Actuals and forecast in one tidy table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actual_vs_forecast(
    actual: DataFrame,
    forecast: DataFrame,
    as_of: date,
    actual_label: str = "actual",
    forecast_label: str = "forecast",
) -> DataFrame:
    """History since the start of last year followed by the forecast, tagged by scenario.

    Both inputs carry date, branch, product and value.
    """
    columns = ["date", "branch", "product", F.col("value").cast("double").alias("value")]
    recent = actual.filter(F.col("date") >= F.lit(date(as_of.year - 1, 1, 1)))
    return recent.select(*columns, F.lit(actual_label).alias("scenario")).unionByName(
        forecast.select(*columns, F.lit(forecast_label).alias("scenario"))
    )


def branch_choices(scenarios: DataFrame) -> DataFrame:
    """The branches a viewer can pick from; the first one is the default."""
    branches = scenarios.select("branch").distinct()
    first = branches.agg(F.min("branch")).scalar()
    return branches.select(
        "branch", (F.col("branch") == first).cast("int").alias("is_default")
    ).orderBy("branch")
