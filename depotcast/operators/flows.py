"""Monthly flows: units invoiced, units produced and demand by product."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.config import PRODUCTS
from depotcast.contracts import MOVEMENT, SALE, UNIT_CURRENT, placed_by, require
from depotcast.functions.dates import month_end
from depotcast.operators.sites import place_column, to_branches


def invoiced_units(
    movements: DataFrame, entry_status: int = 0, sites: DataFrame | None = None
) -> DataFrame:
    """Distinct units leaving ``entry_status`` per branch and month."""
    require(movements, placed_by(MOVEMENT, sites), "movements")
    place = place_column(sites)
    once = (
        movements.filter(F.col("prev_status") == entry_status)
        .select(month_end(F.col("moved_ts")).alias("month_end"), place, "unit_id").distinct()
    )
    if sites is not None:
        once = once.join(sites.select("site", "branch"), "site", "left")
    return once.groupBy("month_end", "branch").agg(F.count_distinct("unit_id").alias("invoiced_units"))


def produced_units(
    units: DataFrame, register: DataFrame, country: str, sites: DataFrame | None = None
) -> DataFrame:
    """Units created per branch and month, for the registered branches of one country."""
    require(units, placed_by(UNIT_CURRENT, sites), "current units")
    monthly = to_branches(
        units.groupBy(month_end(F.col("created_ts")).alias("month_end"), place_column(sites)).agg(
            F.count("unit_id").alias("produced_units")
        ),
        sites, ["month_end"], ["produced_units"],
    )
    home = register.filter(F.col("country") == country).select("branch")
    return monthly.join(home, "branch").select("month_end", "branch", "produced_units")


def demand_by_product(
    sales: DataFrame,
    since: date,
    classes: tuple[str, ...] = PRODUCTS,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Paid sales per branch and month, one count column per product."""
    require(sales, placed_by(SALE, sites), "sales")
    monthly = (
        sales.filter(F.col("paid_on") >= F.lit(since))
        .groupBy(month_end(F.col("paid_on")).alias("month_end"), place_column(sites))
        .agg(
            *[
                F.count(F.when(F.col("product") == label, F.col("sale_id"))).alias(f"sales_{product}")
                for product, label in zip(PRODUCTS, classes)
            ]
        )
    )
    return to_branches(monthly, sites, ["month_end"], [f"sales_{product}" for product in PRODUCTS])
