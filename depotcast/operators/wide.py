"""The wide monthly table: every measure of a branch-month in one row.

All inputs are monthly aggregates unique on their join key, so a consumer that
selects a few columns leaves the optimizer free to drop the joins it does not use.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTH_BRANCH = ["month_end", "branch"]


def _add(base: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        base = base.join(part, _MONTH_BRANCH, "left")
    return base


def wide_table(
    stock: DataFrame,
    invoiced: DataFrame,
    demand: DataFrame,
    workshop: DataFrame,
    segments: DataFrame,
    first: date,
    last: date,
) -> DataFrame:
    """Flow-sum stock with flows and segmentation, for month-ends in [first, last]."""
    labels = segments.select("branch", "pop_letter", "region_consolidated", "urban_tier")
    return (
        _add(stock, invoiced, demand, workshop)
        .join(labels, "branch", "left")
        .filter(F.col("month_end").between(F.lit(first), F.lit(last)))
        .select(
            *stock.columns, "invoiced_units", "sales_new", "sales_semi", "sales_used",
            "maint_internal", "maint_customer", "mech_total", "mech_on_ramp",
            "pop_letter", "region_consolidated", "urban_tier",
        )
        .orderBy(F.desc("month_end"), "branch")
    )


def wide_table_snapshot(
    stock: DataFrame,
    invoiced: DataFrame,
    produced: DataFrame,
    demand: DataFrame,
    workshop: DataFrame,
) -> DataFrame:
    """Month-end stock with flows, all months."""
    return _add(stock, invoiced, produced, demand, workshop).select(
        *stock.columns, "invoiced_units", "produced_units",
        "sales_new", "sales_semi", "sales_used", "maint_internal", "maint_customer",
        "mech_total", "mech_present", "mech_on_ramp",
    )


def planning_table(snapshot_wide: DataFrame, segments: DataFrame) -> DataFrame:
    """The wide contract every rollup, panel and forecast reads: stock, flows and geography."""
    geography = segments.select(
        "branch", "city", "state", "region", "population", "pop_bucket", "pop_letter",
        "region_consolidated", "urban_tier", "is_capital",
    )
    return snapshot_wide.join(geography, "branch", "left").select(
        *snapshot_wide.columns, *[c for c in geography.columns if c != "branch"]
    )
