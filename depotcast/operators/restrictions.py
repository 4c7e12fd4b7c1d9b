"""Restrictions in force on the units of a branch when a month opens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotcast.contracts import RESTRICTION, UNIT_HISTORY, require
from depotcast.functions.dates import first_opening_on_or_after, is_month_opening


def _in_force_by_opening(restrictions: DataFrame, last_opening) -> DataFrame:
    """(unit, description, opening) -> number of restrictions in force on that day.

    A restriction is in force at an opening O when its start date is not after O
    and its end date, if any, is after O. Only openings matter, so each one is a
    +1 at the first opening it covers and a -1 at the first it no longer covers;
    the running sum of the changes is the number in force. A unit with very many
    restrictions shrinks to its changes per month before the shuffle, and no
    restriction is ever paired with another.
    """
    starts = first_opening_on_or_after(F.col("valid_from"))
    ends = first_opening_on_or_after(F.col("valid_to"))
    spans = (
        restrictions.select("unit_id", "description", starts.alias("starts"), ends.alias("ends"))
        .filter(F.col("starts") <= last_opening)
        .filter(F.col("ends").isNull() | (F.col("starts") < F.col("ends")))
    )
    changes = spans.select(
        "unit_id",
        "description",
        F.explode(
            F.array(
                F.struct(F.col("starts").alias("opening"), F.lit(1).alias("change")),
                F.struct(F.col("ends").alias("opening"), F.lit(-1).alias("change")),
            )
        ).alias("step"),
    ).filter(F.col("step.opening").isNotNull())
    monthly = changes.groupBy("unit_id", "description", F.col("step.opening").alias("opening")).agg(
        F.sum("step.change").alias("change")
    )
    by_time = Window.partitionBy("unit_id", "description").orderBy("opening")
    levels = monthly.select(
        "unit_id",
        "description",
        "opening",
        F.sum("change").over(by_time).alias("in_force"),
        F.coalesce(
            F.add_months(F.lead("opening").over(by_time), -1), last_opening
        ).alias("until"),
    ).filter((F.col("in_force") > 0) & (F.col("opening") <= last_opening))
    return levels.select(
        "unit_id",
        "description",
        "in_force",
        F.explode(
            F.sequence(
                "opening", F.least("until", last_opening), F.expr("interval 1 month")
            )
        ).alias("opening"),
    )


def active_restrictions(
    history: DataFrame, restrictions: DataFrame, status_ids: Sequence[int]
) -> DataFrame:
    """Restrictions in force per (month, branch, description) on month-opening snapshots.

    Snapshots of units without any restriction in force are counted under a NULL
    description, as a left join would.
    """
    require(history, UNIT_HISTORY.names, "unit history")
    require(restrictions, RESTRICTION.names, "restrictions")
    last_opening = history.agg(F.trunc(F.max("snapshot_ts").cast("date"), "MM")).scalar()
    openings = (
        history.filter(is_month_opening(F.col("snapshot_ts")) & F.col("status_id").isin(*status_ids))
        .groupBy("unit_id", F.col("snapshot_ts").cast("date").alias("opening"), "branch")
        .agg(F.count("unit_id").alias("snapshots"))
    )
    # a row per month in force: far more than the size of the restrictions tells, so never broadcast
    in_force = _in_force_by_opening(restrictions, last_opening).hint("merge")
    return (
        openings.join(in_force, ["unit_id", "opening"], "left")
        .groupBy(F.date_sub("opening", 1).alias("month_end"), "branch", "description")
        .agg(
            F.sum(F.col("snapshots") * F.coalesce("in_force", F.lit(1))).alias("restrictions")
        )
    )
