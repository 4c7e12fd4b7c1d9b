"""Stock positions from dated snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.config import StockLabels
from depotcast.contracts import STOCK_SNAPSHOT, placed_by, require
from depotcast.functions.dates import (
    MONTH_PARTITION,
    between_days,
    closing_month_end,
    in_partitions,
    is_month_opening,
    month_ends,
    next_month,
    on_days,
    openings_between,
)
from depotcast.functions.measures import FLOW_MEASURES, measures_named, quoted, stock_measures
from depotcast.operators.sites import place_column, to_branches
from depotcast.runtime import materialize

_KEYS = ("branch", "country", "third_party")


def check_inputs(snapshots: DataFrame, register: DataFrame, sites: DataFrame | None = None) -> None:
    """Fail with the names of missing columns before anything is read."""
    require(snapshots, placed_by(STOCK_SNAPSHOT, sites), "stock snapshots")
    require(register, _KEYS, "branch register")


def stock_flow_sum(
    snapshots: DataFrame,
    register: DataFrame,
    labels: StockLabels,
    country: str,
    first: date | None = None,
    last: date | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Every snapshot of one country in a month, summed per own branch.

    The country is the one the snapshot states; the result shows the register's.
    The snapshots are aggregated first and meet the register, and before it the
    ``sites`` (site, branch, country) if they name those, afterwards. ``first`` and
    ``last`` limit the result to those months, on the raw column, so that other
    months are not read.
    """
    check_inputs(snapshots, register, sites)
    measures = measures_named(labels, FLOW_MEASURES)
    if first is not None and last is not None:
        # the snapshot that closes the last month is of the first day of the next one
        snapshots = between_days(snapshots, "snapshot_ts", first.replace(day=2), next_month(last).replace(day=2))
    if sites is None:
        snapshots = snapshots.filter(F.col("country") == country)
    else:
        sites = sites.filter(F.col("country") == country)
    monthly = to_branches(
        snapshots.groupBy(
            closing_month_end(F.col("snapshot_ts")).alias("month_end"), place_column(sites)
        ).agg(*[m.total() for m in measures]),
        sites, ["month_end"], [m.name for m in measures],
    )
    own = register.filter(F.col("third_party") == 0)
    return monthly.join(own.select("branch", "country"), "branch").select(
        "month_end", "country", "branch", *[m.name for m in measures]
    )


def snapshot_span(snapshots: DataFrame) -> tuple[date, date] | None:
    """First and last snapshot day: a scan of one column and one row for the driver.

    None for an empty table.
    """
    day = F.col("snapshot_ts").cast("date")
    first, last = snapshots.agg(F.min(day), F.max(day)).first()
    return None if first is None else (first, last)


def _latest_day(snapshots: DataFrame, span: tuple[date, date] | None) -> Column:
    if span is not None:
        return F.lit(span[1])
    return snapshots.agg(F.max("snapshot_ts").cast("date")).scalar()


Months = tuple[date, date]


def _labelled_openings(
    snapshots: DataFrame, include_latest: bool, span: tuple[date, date] | None, months: Months | None
) -> tuple[DataFrame, Column]:
    """The snapshots that open a month, and the latest ones if wanted, and their month-end.

    With a ``span`` the days to keep are known beforehand. A condition of its own names them as
    ranges of the raw column, which is what reaches the file scan (and the list of partitions, where
    the table has any); rows outside the span pass it, so that they can be reported. The ranges are
    many, so a row meets them last: nearly all are dropped by the day of the month before.
    """
    moment = F.col("snapshot_ts")
    keep, label = is_month_opening(moment), F.date_sub(moment.cast("date"), 1)
    if include_latest:
        newest = _latest_day(snapshots, span)
        # nothing is later than the latest day
        is_newest = moment >= newest.cast("timestamp_ntz")
        keep = keep | is_newest
        label = F.when(is_newest, F.last_day(newest)).otherwise(label)
    if months is not None:
        first, last = months[0].replace(day=1), next_month(months[1])
        # a month is closed by the snapshot of the next month's first day, or by the latest one
        snapshots = between_days(snapshots, "snapshot_ts", first, last.replace(day=2))
        keep = keep & label.between(F.last_day(F.lit(first)), F.last_day(F.lit(months[1])))
    if span is None:
        return snapshots.filter(keep), label
    timed = moment.isNotNull()  # no other condition then looks for nulls, once per range
    closed = [(x, x - timedelta(days=1)) for x in openings_between(*span)]
    closed += [(span[1], span[1])] if include_latest else []
    if months is None:
        outside = (moment < F.lit(span[0])) | (moment >= F.lit(span[1] + timedelta(days=1)))
        days = [day for day, _ in closed]
        elsewhere = on_days("snapshot_ts", days) if days else F.lit(False)
        stale = F.raise_error(F.lit(f"a snapshot lies outside {span[0]} to {span[1]}")).cast("date")
        label = F.when(outside, stale).otherwise(label)
        kept = in_partitions(snapshots, days, span).filter(timed & (outside | keep))
        # partitions by month have told which files to read: no ranges there
        return kept if MONTH_PARTITION in snapshots.columns else kept.filter(outside | elsewhere), label
    days = [day for day, month in closed if first <= month < last]
    elsewhere = on_days("snapshot_ts", days) if days else F.lit(False)
    return in_partitions(snapshots, days).filter(timed & keep & elsewhere), label


def stock_month_end(
    snapshots: DataFrame,
    register: DataFrame,
    labels: StockLabels,
    include_latest: bool = True,
    measures: Sequence[str] | None = None,
    span: tuple[date, date] | None = None,
    sites: DataFrame | None = None,
    month: date | None = None,
    months: Months | None = None,
) -> DataFrame:
    """Month-end stock: the snapshots that open a month, and the latest one if wanted.

    A month-opening snapshot is labelled with the day before it; the latest one
    with the end of its own month. Branches missing from the register are added
    up under a NULL branch. ``measures`` limits the result to some of the 32
    measures. With the ``span`` of the snapshots at hand the days to keep are
    spelled out as ranges that reach the file scan, so that a table sorted or
    partitioned by time is read for those days only; the query fails if a snapshot
    lies outside it. ``sites`` gives the branch of each site if the snapshots name sites.
    ``month`` limits the result to the month of that day, ``months`` to those from one day's to
    another's, and the scan to their days.
    """
    require(snapshots, placed_by(STOCK_SNAPSHOT, sites), "stock snapshots")
    require(register, ("branch", "country"), "branch register")
    if month is not None:
        months = (month, month)
    kept, label = _labelled_openings(snapshots, include_latest, span, months)
    wanted = stock_measures(labels) if measures is None else measures_named(labels, measures)
    names = [m.name for m in wanted]
    monthly = to_branches(
        kept.groupBy(label.alias("month_end"), place_column(sites)).agg(*[m.total() for m in wanted]),
        sites, ["month_end"], names,
    )
    known = register.select(F.col("branch").alias("known_branch"), "country")
    # the second, tiny aggregation folds unregistered branches into one group
    return (
        monthly.join(known, F.col("branch") == F.col("known_branch"), "left")
        .groupBy("month_end", "country", F.col("known_branch").alias("branch"))
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def branch_months(
    snapshots: DataFrame,
    register: DataFrame,
    include_latest: bool = True,
    span: tuple[date, date] | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """First and last month of every registered branch in the month-end stock.

    Reads the moment and the place of the days that ``stock_month_end`` keeps and no measure, so it
    tells which branches and months there are before any month is worked out.
    """
    require(snapshots, ["snapshot_ts", place_column(sites)], "stock snapshots")
    kept, label = _labelled_openings(snapshots, include_latest, span, None)
    place = place_column(sites)
    spans = kept.groupBy(place).agg(F.min(label).alias("first_month"), F.max(label).alias("last_month"))
    if sites is not None:
        spans = spans.join(sites.select("site", "branch"), "site", "left")
    spans = spans.groupBy("branch").agg(F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"))
    return spans.join(register.select("branch"), "branch")


def _sale_total(labels: StockLabels) -> Column:
    return F.expr(f"sum(CASE WHEN status_type = {quoted(labels.sale)} THEN qty ELSE 0 END)")


def branch_month_grid(
    snapshots: DataFrame, labels: StockLabels, as_of: date, sites: DataFrame | None = None
) -> DataFrame:
    """Sale stock on every (month, branch): closed months so far and the next twelve.

    The status tells a measured month from an empty one and both from a month
    that is still open at ``as_of``.
    """
    day = F.lit(as_of)
    open_month = F.last_day(F.date_sub(day, 1))
    # read by the months, the branches and the values below: written once
    measured = materialize(
        to_branches(
            snapshots.groupBy(
                closing_month_end(F.col("snapshot_ts")).alias("month_end"), place_column(sites)
            ).agg(_sale_total(labels).alias("measured")),
            sites, ["month_end"], ["measured"],
        )
    )
    history = measured.filter(F.col("month_end") < open_month).agg(
        F.collect_set("month_end")
    ).scalar()
    # both arrays hold one entry per calendar month
    months = F.array_union(history, month_ends(day, F.add_months(day, 11)))
    grid = (
        measured.filter(F.col("branch").isNotNull()).select("branch").distinct()
        .select("branch", F.explode(months).alias("month_end"))
    )
    return grid.join(measured, ["month_end", "branch"], "left").select(
        "month_end",
        "branch",
        F.coalesce("measured", F.lit(0)).alias("sale_total"),
        F.when(F.col("month_end") >= open_month, "forecast")
        .when(F.col("measured").isNull(), "empty")
        .otherwise("actual")
        .alias("status"),
    ).orderBy("branch", "month_end")


def company_closed_months(
    snapshots: DataFrame, labels: StockLabels, span: tuple[date, date] | None = None
) -> DataFrame:
    """Sale stock per snapshot date, up to the month of the latest snapshot."""
    closing = F.last_day(F.date_sub(_latest_day(snapshots, span), 1))
    return (
        # date(ts) - 1 < closing, on the raw column
        snapshots.filter(F.col("snapshot_ts") < F.date_add(closing, 1).cast("timestamp_ntz"))
        .groupBy(F.date_sub(F.col("snapshot_ts").cast("date"), 1).alias("date"))
        .agg(_sale_total(labels).alias("sale_total"))
        .withColumn("status", F.lit("actual"))
        .orderBy("date")
    )
