"""Workshop productivity: jobs finished against the mechanics available."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.contracts import DAILY_INDICATOR, MAINTENANCE, placed_by, require
from depotcast.functions.dates import after_day, month_end
from depotcast.operators.sites import place_column, to_branches

_INDICATORS = ("mech_total", "mech_present", "mech_on_ramp")


def _monthly_jobs(
    maintenance: DataFrame, since: date, internal: str, sites: DataFrame | None
) -> DataFrame:
    require(maintenance, placed_by(MAINTENANCE, sites), "maintenance")
    kind, job = F.col("job_type"), F.col("job_id")
    counts = (
        maintenance.filter(after_day(F.col("finished_ts"), since))
        .groupBy(place_column(sites), month_end(F.col("finished_ts")).alias("month_end"))
        .agg(
            F.count(F.when(kind == internal, job)).alias("maint_internal"),
            F.count(F.when(kind != internal, job)).alias("maint_customer"),
        )
    )
    return to_branches(counts, sites, ["month_end"], ["maint_internal", "maint_customer"])


def _monthly_indicators(indicators: DataFrame) -> DataFrame:
    require(indicators, DAILY_INDICATOR.names, "daily indicators")
    return indicators.groupBy("branch", month_end(F.col("day")).alias("month_end")).agg(
        F.count(F.lit(1)).alias("indicator_days"), *[F.avg(c).alias(c) for c in _INDICATORS]
    )


def workshop_agg_then_join(
    maintenance: DataFrame,
    indicators: DataFrame,
    since: date,
    internal: str,
    indicators_since: date | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Job counts and average mechanics per (branch, month), each side counted once."""
    if indicators_since is not None:
        indicators = indicators.filter(F.col("day") > F.lit(indicators_since))
    jobs = _monthly_jobs(maintenance, since, internal, sites)
    return jobs.join(_monthly_indicators(indicators), ["branch", "month_end"], "left").select(
        "branch", "month_end", "maint_internal", "maint_customer", *_INDICATORS
    )


def workshop_join_then_agg(
    maintenance: DataFrame,
    indicators: DataFrame,
    since: date,
    internal: str,
    sites: DataFrame | None = None,
) -> DataFrame:
    """As above with every job paired with every indicator day of its branch-month.

    Each job is counted once per indicator day (once when there is none), while an
    average over the pairs equals the average over the days. Both follow from the
    two monthly aggregates, so the pairs themselves are never formed.
    """
    jobs = _monthly_jobs(maintenance, since, internal, sites)
    days = F.coalesce("indicator_days", F.lit(1))
    return jobs.join(_monthly_indicators(indicators), ["branch", "month_end"], "left").select(
        "branch",
        "month_end",
        (F.col("maint_internal") * days).alias("maint_internal"),
        (F.col("maint_customer") * days).alias("maint_customer"),
        "mech_total",
        "mech_on_ramp",
    )
