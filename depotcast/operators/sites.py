"""Facts that name a site (a supplier, a customer) rather than the branch it belongs to.

Such facts are aggregated by site first, below any exchange, and meet the table of sites
afterwards: no raw row is shuffled to find its branch, and a site that holds a large share of
the rows shrinks where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place_column(sites: DataFrame | None) -> str:
    return "branch" if sites is None else "site"


def to_branches(
    totals: DataFrame, sites: DataFrame | None, keys: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Additive totals by ``keys`` and place, as totals by ``keys`` and branch.

    ``sites`` gives the branch of each site, once; unknown sites belong to a NULL branch.
    """
    if sites is None:
        return totals
    placed = totals.join(sites.select("site", "branch"), "site", "left")
    return placed.groupBy(*keys, "branch").agg(*[F.sum(c).alias(c) for c in sums])
