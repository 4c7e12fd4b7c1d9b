"""Calendar expressions shared by the monthly operators."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_end(moment: Column) -> Column:
    return F.last_day(moment.cast("date"))


def closing_month_end(moment: Column) -> Column:
    """Month a snapshot closes: a snapshot describes the end of the day before it."""
    return F.last_day(F.date_sub(moment.cast("date"), 1))


def is_month_opening(moment: Column) -> Column:
    return F.dayofmonth(moment) == 1


def openings_between(first: date, last: date) -> list[date]:
    """First days of the months of two dates and of those in between."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [date(m // 12, m % 12 + 1, 1) for m in months]


def on_days(column: str, days: Iterable[date]) -> Column:
    """The timestamp column falls on one of the days, as ranges of the raw column."""
    ranges = [
        f"({column} >= timestamp_ntz'{x}' AND {column} < timestamp_ntz'{x + timedelta(days=1)}')"
        for x in sorted(set(days))
    ]
    return F.expr(" OR ".join(ranges))


def next_month(day: date) -> date:
    """First day of the month after the one of ``day``."""
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


#: The column by which fact tables are partitioned on disk: first day of the month of the fact's moment.
MONTH_PARTITION = "fact_month"


def in_partitions(df: DataFrame, days: Iterable[date], beyond: tuple[date, date] | None = None) -> DataFrame:
    """``df`` without the month partitions that hold none of the days, if it is partitioned by month.

    Partitions before the first and after the last day of ``beyond`` stay as well.
    """
    if MONTH_PARTITION not in df.columns:
        return df
    month = F.col(MONTH_PARTITION)
    wanted = month.isin(*[F.lit(x) for x in sorted({day.replace(day=1) for day in days})])
    if beyond is not None:
        wanted = wanted | (month < F.lit(beyond[0].replace(day=1))) | (month > F.lit(beyond[1].replace(day=1)))
    return df.filter(wanted)


def between_days(df: DataFrame, moment: str, first: date, following: date) -> DataFrame:
    """Rows from the day ``first`` up to before the day ``following``, as a range of the raw
    column, and of the month partitions if there are any."""
    rows = df.filter((F.col(moment) >= F.lit(first)) & (F.col(moment) < F.lit(following)))
    if MONTH_PARTITION not in df.columns:
        return rows
    return rows.filter((F.col(MONTH_PARTITION) >= F.lit(first.replace(day=1))) & (F.col(MONTH_PARTITION) < F.lit(following)))


def first_opening_on_or_after(moment: Column) -> Column:
    """First day of the earliest month that does not open before ``moment``'s date."""
    day = moment.cast("date")
    return F.when(F.dayofmonth(day) == 1, day).otherwise(F.date_add(F.last_day(day), 1))


def after_day(moment: Column, day: date) -> Column:
    """``date(moment) > day`` written on the raw column so that it reaches the file scan."""
    return moment >= F.lit(day + timedelta(days=1))


def month_ends(first: Column, last: Column) -> Column:
    """Array of the month-ends from ``first`` to ``last``, stepped over month starts."""
    starts = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    return F.transform(starts, lambda start: F.last_day(start))
