"""Branch segmentation by the population of its city."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.config import SegmentRules
from depotcast.contracts import BRANCH_REGISTER, require
from depotcast.operators.ranking import with_global_ntile


def _letter(bucket: Column, rules: SegmentRules) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in rules.letters]), bucket)


def _tier(bucket: Column, rules: SegmentRules) -> Column:
    (first, name), *rest = rules.tiers
    banded = reduce(lambda c, t: c.when(bucket >= t[0], t[1]), rest, F.when(bucket >= first, name))
    return banded.otherwise(rules.lowest_tier)


def _consolidated(rules: SegmentRules) -> Column:
    cases = [(F.col("country") == k, label) for k, label in rules.country_overrides.items()]
    cases += [
        ((F.col("region") == region) & (F.col("city") == city), label)
        for (region, city), label in rules.capital_overrides.items()
    ]
    if not cases:
        return F.col("region")
    (first, label), *rest = cases
    chain = reduce(lambda c, t: c.when(t[0], t[1]), rest, F.when(first, label))
    return chain.otherwise(F.col("region"))


def branch_segments(register: DataFrame, rules: SegmentRules) -> DataFrame:
    """Population bucket, letter, urban tier and consolidated region of each branch.

    Branches without a population are left out; equal populations are ordered by
    branch so that the buckets are reproducible.
    """
    require(register, BRANCH_REGISTER.names, "branch register")
    ranked = with_global_ntile(
        register.filter(F.col("population").isNotNull()),
        rules.buckets,
        ["population", "branch"],
        "pop_bucket",
    )
    bucket = F.col("pop_bucket")
    is_capital = F.lit(False)
    for region, city in rules.capital_overrides:
        same = (F.col("region") == region) & (F.col("city") == city)
        is_capital = is_capital | F.coalesce(same, F.lit(False))
    return ranked.select(
        "branch", "country", "city", "state", "region", "third_party", "population", "pop_bucket",
        _letter(bucket, rules).alias("pop_letter"),
        _tier(bucket, rules).alias("urban_tier"),
        _consolidated(rules).alias("region_consolidated"),
        is_capital.cast("int").alias("is_capital"),
    )
