"""Reports over the long tables: summaries, totals, shares, rankings and cross-tabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.config import PRODUCTS, TOTAL
from depotcast.contracts import RENTED_COLUMNS, require
from depotcast.functions.numbers import ratio_or_null, ratio_or_zero


def _without_total(long: DataFrame) -> DataFrame:
    return long.filter(F.col("product") != TOTAL)


def dataset_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, period and the number of distinct values of the date and each key."""
    return long.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("date").alias("n_date"),
        *[F.count_distinct(k).alias(f"n_{k}") for k in keys],
    )


def _totals(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        _without_total(long)
        .filter(" and ".join(f"{k} is not null" for k in keys))
        .groupBy(*keys)
        .agg(F.sum("value").alias("total"))
    )


def totals_by_key(long: DataFrame, *keys: str) -> DataFrame:
    """Totals per key, largest first, without the synthetic total product."""
    return _totals(long, keys).orderBy(F.desc("total"), *keys)


def grand_total(long: DataFrame) -> DataFrame:
    return _without_total(long).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"))


def top_keys(long: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    return totals_by_key(long, *keys).limit(n)


def share_by_key(long: DataFrame, key: str) -> DataFrame:
    """Each key's percentage of the grand total; 0 when there is nothing to share."""
    totals = _totals(long, [key])
    # reads the same shuffled totals as the main plan, which Spark runs once
    everything = totals.agg(F.sum("total")).scalar()
    return totals.select(
        key, "total", (ratio_or_zero(F.col("total"), everything) * 100).alias("pct")
    ).orderBy(F.desc("total"), key)


def population_by_country(long: DataFrame) -> DataFrame:
    """The distinct city populations behind the population rollup."""
    return long.select("country", "population").distinct().orderBy("country", "population")


def per_capita(wide: DataFrame) -> DataFrame:
    """Rented units of the whole period per inhabitant of the country's cities."""
    products = [c for c, product in RENTED_COLUMNS.items() if product != TOTAL]
    require(wide, ["country", "state", "city", "population", *products], "wide table")
    units = sum((F.coalesce(F.col(c), F.lit(0)) for c in products), F.lit(0))
    cities = (
        wide.filter(F.col("country").isNotNull() & F.col("population").isNotNull())
        .groupBy("country", "state", "city")
        .agg(F.sum(units).alias("value"), F.max("population").alias("population"))
    )
    return (
        cities.groupBy("country")
        .agg(F.sum("value").alias("value"), F.sum("population").alias("population"))
        .withColumn("per_capita", ratio_or_zero(F.col("value"), F.col("population")))
    )


def cross_tab(
    long: DataFrame, key: str, products: Sequence[str] = (*PRODUCTS, TOTAL), fill: bool = False
) -> DataFrame:
    """One row per key, one column per product; missing cells stay NULL unless filled with 0."""
    table = (
        long.filter(F.col(key).isNotNull()).groupBy(key).pivot("product", list(products)).agg(F.sum("value"))
    )
    return table.na.fill(0, list(products)) if fill else table


def missing_columns(wide: DataFrame, requested: Sequence[str]) -> list[str]:
    return [c for c in requested if c not in wide.columns]


def operating_ratios() -> list[Column]:
    """Utilisation, maintenance and readiness per operational unit; NULL without any."""
    operational = F.col("operational_total")
    pairs = {
        "utilisation": "rented_total", "maintenance_index": "maintenance_total",
        "ready_index": "ready_total",
    }
    return [
        F.round(ratio_or_null(F.col(source), operational), 4).alias(name)
        for name, source in pairs.items()
    ]


def ops_list(
    wide: DataFrame,
    year: int,
    month: int,
    requested: Sequence[str],
    sort_by: str,
    ratios: bool = False,
) -> DataFrame:
    """One month of the wide table, the requested columns that exist, largest first.

    Columns that do not exist are skipped; ``missing_columns`` names them.
    """
    day = F.col("month_end")
    if dict(wide.dtypes)["month_end"] == "string":
        wide, day = wide.withColumn("month_end", F.try_to_date("month_end")), F.col("month_end")
    present = [c for c in requested if c in wide.columns]
    tie_breakers = [c for c in ("branch",) if c in wide.columns]
    return (
        wide.filter((F.year(day) == year) & (F.month(day) == month))
        .orderBy(F.desc_nulls_last(sort_by), *tie_breakers)
        .select("month_end", *present, *(operating_ratios() if ratios else []))
    )
