"""Numeric expressions: tolerant parsing, guarded ratios and the log scale of the target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0))


def to_log(value: Column) -> Column:
    return F.log1p(value)


def from_log(value: Column) -> Column:
    """Back to units: never negative, two decimals."""
    return F.round(F.greatest(F.expm1(value), F.lit(0.0)), 2)
