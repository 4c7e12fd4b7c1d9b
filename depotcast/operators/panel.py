"""From the wide table to a dense month x branch x product panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.contracts import OPERATIONAL_COLUMNS, SALES_COLUMNS, STATIC_COLUMNS, require
from depotcast.functions.dates import month_ends, next_month
from depotcast.operators.rollups import to_products

# days of operation below which a branch belongs to the class
MATURITY_BANDS = ((60, "just opened"), (180, "young"), (360, "intermediate"))
OLDEST_BAND = "mature"


def clean_wide(wide: DataFrame, operational: Sequence[str] = OPERATIONAL_COLUMNS) -> DataFrame:
    """Rows with a branch and a date, dated at month-end, operational columns zero-filled."""
    require(wide, ["month_end", "branch", *operational], "wide table")
    return (
        wide.na.drop(subset=["branch", "month_end"])
        .withColumn("month_end", F.last_day("month_end"))
        .na.fill(0, list(operational))
    )


def panel_long(
    clean: DataFrame,
    statics: Sequence[str] = STATIC_COLUMNS,
    operational: Sequence[str] = OPERATIONAL_COLUMNS,
    columns: Mapping[str, str] = SALES_COLUMNS,
) -> DataFrame:
    """One row per month, branch and product with the branch's attributes and operation."""
    keys = ["month_end", "branch", *statics, *operational]
    require(clean, [*keys, *columns], "clean wide table")
    return to_products(clean.select(*keys, *columns), keys, columns).withColumnsRenamed(
        {"month_end": "date", "pop_letter": "rank"}
    )


def _renamed(statics: Sequence[str]) -> list[str]:
    return ["rank" if c == "pop_letter" else c for c in statics]


def densify(
    long: DataFrame,
    statics: Sequence[str] = STATIC_COLUMNS,
    operational: Sequence[str] = OPERATIONAL_COLUMNS,
    strict_static: bool = False,
    branches: DataFrame | None = None,
    months: tuple[date, date] | None = None,
    products: Sequence[str] | None = None,
) -> DataFrame:
    """Every month from first to last for every branch and product, gaps filled with 0.

    Attributes come from the latest month of each (branch, product). With
    ``strict_static`` a row counts only if its attributes are still those of the
    latest month; the default keeps it. Reads ``long`` several times: pass a
    written or materialised table.

    A ``long`` that holds the latest months only lacks branches without a row in them:
    ``branches`` has all of them with their attributes, which count where ``long`` has none.
    ``months`` are then the panel's first and last month, ``products`` all its products.
    """
    statics = _renamed(statics)
    series = ["branch", "product"]
    require(long, ["date", *series, *statics, *operational, "value"], "panel")
    if months is None:
        span = long.agg(month_ends(F.min("date"), F.max("date"))).scalar()
    else:
        span = month_ends(F.lit(months[0]), F.lit(months[1]))
    # one entry per product class, a handful whatever the number of rows
    classes = (
        long.agg(F.array_sort(F.collect_set("product"))).scalar() if products is None
        else F.array(*[F.lit(p) for p in sorted(products)])
    )
    listed = long.select("branch") if branches is None else long.select("branch").union(branches.select("branch"))
    skeleton = (
        listed.distinct()
        .select("branch", F.explode(classes).alias("product"))
        .select("*", F.explode(span).alias("date"))
    )
    latest = long.groupBy(*series).agg(F.max_by(F.struct(*statics), "date").alias("latest"))
    if branches is not None:
        require(branches, ["branch", *statics], "branches")
        given = branches.select("branch", F.struct(*statics).alias("given"))
        pairs = skeleton.select(*series).distinct()
        latest = (
            pairs.join(latest, series, "left").join(given, "branch", "left")
            .select(*series, F.coalesce("latest", "given").alias("latest"))
        )
    latest = latest.select(*series, "latest.*")
    facts = long.select("date", *series, *statics, *operational, "value")
    keys = ["date", *series]
    template = skeleton.join(latest, series, "left")
    if strict_static:
        right = facts.withColumnsRenamed({c: f"_{c}" for c in [*keys, *statics]})
        match = [template[c].eqNullSafe(right[f"_{c}"]) for c in [*keys, *statics]]
        joined = template.join(right, match, "left")
    else:
        joined = template.join(facts.drop(*statics), keys, "left")
    return joined.select(
        *keys,
        *statics,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in operational],
        F.coalesce(F.col("value"), F.lit(0)).cast("long").alias("value"),
    )


def branch_maturity(panel: DataFrame) -> DataFrame:
    """Days between a branch's first and last month with sales, and its maturity class.

    A branch that never sold has 0 days and starts at the panel's first month.
    """
    start = panel.agg(F.min("date")).scalar()
    sold = F.when(F.col("value") > 0, F.col("date"))
    spans = panel.groupBy("branch").agg(F.min(sold).alias("first"), F.max(sold).alias("last"))
    days = F.coalesce(F.date_diff("last", "first"), F.lit(0)).cast("long")
    (limit, name), *rest = MATURITY_BANDS
    band = F.when(F.col("days") < limit, name)
    for limit, name in rest:
        band = band.when(F.col("days") < limit, name)
    return (
        spans.select("branch", F.coalesce("first", start).alias("first_date"), days.alias("days"))
        .withColumn("months", F.col("days") / 30)
        .withColumn("maturity", band.otherwise(OLDEST_BAND))
    )


def recency_window(panel: DataFrame, months: int = 24) -> DataFrame:
    """Rows not older than ``months`` before the latest date, both ends included."""
    oldest = panel.agg(F.add_months(F.max("date"), -months)).scalar()
    return panel.filter(F.col("date") >= oldest)


def window_start(first: date, last: date, months: int = 24) -> date:
    """First month-end of the recency window of a panel that runs from ``first`` to ``last``."""
    count = last.year * 12 + last.month - 1 - months
    opening = date(count // 12, count % 12 + 1, 1)
    return max(first, next_month(opening) - timedelta(days=1))
