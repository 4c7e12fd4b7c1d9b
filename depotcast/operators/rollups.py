"""Wide to long, and the hierarchy rollups of the rented stock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.contracts import RENTED_COLUMNS, require
from depotcast.functions.numbers import number_or_zero

# level -> keys it is rolled up by, next to the month
LEVELS: dict[str, tuple[str, ...]] = {
    "company": (),
    "country": ("country",),
    "region": ("country", "region", "region_consolidated"),
    "state": ("country", "state"),
    "pop_rank": ("country", "pop_letter"),
    "urban_tier": ("country", "urban_tier"),
    "population": ("country", "population"),
}


def product_name(column: Column, names: Mapping[str, str]) -> Column:
    """Map measure column names to product names."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(mapping, column)


def to_products(
    wide: DataFrame, keys: Sequence[str], columns: Mapping[str, str], value: str = "value"
) -> DataFrame:
    """One row per key and product. NULL values are kept as rows."""
    return wide.unpivot(list(keys), list(columns), "_measure", value).select(
        *keys, product_name(F.col("_measure"), columns).alias("product"), value
    )


def branch_product_long(wide: DataFrame, columns: Mapping[str, str] = RENTED_COLUMNS) -> DataFrame:
    """Branch level, not aggregated; what is not a number becomes 0."""
    require(wide, ["month_end", "country", "branch", *columns], "wide table")
    numeric = wide.select(
        F.col("month_end").alias("date"), "country", "branch",
        *[number_or_zero(F.col(c)).alias(c) for c in columns],
    )
    return to_products(numeric, ["date", "country", "branch"], columns)


def in_report_order(long: DataFrame) -> DataFrame:
    """Sorted for publication: date, keys, product. Not for frames that feed another step."""
    return long.orderBy(*[c for c in long.columns if c != "value"])


def _summed(columns: Mapping[str, str]) -> list[Column]:
    return [F.sum(number_or_zero(F.col(c))).cast("long").alias(c) for c in columns]


def _with_population_number(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "population" not in keys:
        return wide
    return wide.withColumn("population", F.col("population").try_cast("double").cast("long"))


def rollup(
    wide: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str] = RENTED_COLUMNS,
    constants: Mapping[str, str] | None = None,
    renamed: Mapping[str, str] | None = None,
) -> DataFrame:
    """Products summed by month and ``keys``; rows with a NULL key are left out."""
    keys = list(keys)
    require(wide, ["month_end", *keys, *columns], "wide table")
    present = reduce(
        lambda c, k: c & F.col(k).isNotNull(), keys, F.col("month_end").isNotNull()
    )
    summed = (
        _with_population_number(wide, keys)
        .filter(present)
        .groupBy(F.col("month_end").alias("date"), *keys)
        .agg(*_summed(columns))
    )
    long = to_products(summed, ["date", *keys], columns)
    names = dict(renamed or {})
    head = [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return long.select(
        "date", *head, *[F.col(k).alias(names.get(k, k)) for k in keys], "product", "value"
    )


def rollup_all_levels(
    wide: DataFrame,
    columns: Mapping[str, str] = RENTED_COLUMNS,
    levels: Mapping[str, tuple[str, ...]] = LEVELS,
) -> DataFrame:
    """Every rollup in one pass over the wide table, with the level's name as a column."""
    keys = list(dict.fromkeys(k for level in levels.values() for k in level))
    require(wide, ["month_end", *keys, *columns], "wide table")
    base = _with_population_number(wide, keys).filter(F.col("month_end").isNotNull())
    absent = {k: F.grouping(k).alias(f"_absent_{k}") for k in keys}
    grouped = base.groupingSets(
        [["month_end", *level] for level in levels.values()], "month_end", *keys
    ).agg(*_summed(columns), *absent.values())

    def is_level(level: tuple[str, ...]) -> Column:
        # the level's own keys are grouped and not NULL, all others are rolled up
        terms = [
            (F.col(f"_absent_{k}") == 0) & F.col(k).isNotNull()
            if k in level
            else F.col(f"_absent_{k}") == 1
            for k in keys
        ]
        return reduce(lambda a, b: a & b, terms)

    names = [F.when(is_level(level), F.lit(name)) for name, level in levels.items()]
    labelled = grouped.withColumn("level", F.coalesce(*names)).filter(F.col("level").isNotNull())
    return to_products(
        labelled.withColumnRenamed("month_end", "date"), ["level", "date", *keys], columns
    )
