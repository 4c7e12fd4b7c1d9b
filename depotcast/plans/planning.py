"""From the logical inputs to the planning table, whole or for the months that are needed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.config import PRODUCTS, SegmentRules, StockLabels
from depotcast.contracts import OPERATIONAL_COLUMNS, SALES_COLUMNS, STATIC_COLUMNS
from depotcast.functions.dates import between_days, next_month
from depotcast.operators import flows, panel, segments, stock, wide, workshop
from depotcast.operators.stock import Months
from depotcast.runtime import materialize

_STOCK_OF_PANEL = [c for c in OPERATIONAL_COLUMNS if not c.startswith("mech_")]


@dataclass(frozen=True)
class Inputs:
    snapshots: DataFrame
    register: DataFrame
    movements: DataFrame
    units: DataFrame
    maintenance: DataFrame
    indicators: DataFrame
    sales: DataFrame
    # where facts name a site instead of a branch: the sites of stock, units and jobs, and of movements and sales
    stock_sites: DataFrame | None = None
    sale_sites: DataFrame | None = None
    # units at month openings and the restrictions on them, where there are any
    unit_history: DataFrame | None = None
    restrictions: DataFrame | None = None

    def within(self, months: Months) -> Inputs:
        """The facts that the months from one day's to another's are made of, as ranges of the raw columns."""
        first, following = months[0].replace(day=1), next_month(months[1])

        def cut(facts: DataFrame, moment: str) -> DataFrame:
            return between_days(facts, moment, first, following)

        return replace(
            self,
            # the day after the last month closes it
            snapshots=between_days(self.snapshots, "snapshot_ts", first, following.replace(day=2)),
            movements=cut(self.movements, "moved_ts"), units=cut(self.units, "created_ts"),
            maintenance=cut(self.maintenance, "finished_ts"), indicators=cut(self.indicators, "day"),
            sales=cut(self.sales, "paid_on"),
        )


@dataclass(frozen=True)
class Rules:
    """What the planning table depends on besides its inputs."""

    labels: StockLabels
    rules: SegmentRules
    country: str
    since: date
    internal_job: str


def build_wide(inputs: Inputs, rules: Rules, span: tuple[date, date] | None) -> DataFrame:
    """The planning table of all months."""
    position = stock.stock_month_end(
        inputs.snapshots, inputs.register, rules.labels, span=span, sites=inputs.stock_sites
    )
    snapshot_wide = wide.wide_table_snapshot(
        position,
        flows.invoiced_units(inputs.movements, sites=inputs.sale_sites),
        flows.produced_units(inputs.units, inputs.register, rules.country, sites=inputs.stock_sites),
        flows.demand_by_product(inputs.sales, rules.since, rules.labels.classes, sites=inputs.sale_sites),
        workshop.workshop_agg_then_join(
            inputs.maintenance, inputs.indicators, rules.since, rules.internal_job, sites=inputs.stock_sites
        ),
    )
    return wide.planning_table(snapshot_wide, segments.branch_segments(inputs.register, rules.rules))


def build_flow_wide(inputs: Inputs, rules: Rules, first: date, last: date) -> DataFrame:
    """The flow-sum wide table of the month-ends from ``first`` to ``last``."""
    jobs = workshop.workshop_join_then_agg(
        inputs.maintenance, inputs.indicators, rules.since, rules.internal_job, sites=inputs.stock_sites
    )
    return wide.wide_table(
        stock.stock_flow_sum(
            inputs.snapshots, inputs.register, rules.labels, rules.country, first, last, sites=inputs.stock_sites
        ),
        flows.invoiced_units(inputs.movements, sites=inputs.sale_sites),
        flows.demand_by_product(inputs.sales, rules.since, rules.labels.classes, sites=inputs.sale_sites),
        jobs, segments.branch_segments(inputs.register, rules.rules), first, last,
    )


def panel_wide(
    inputs: Inputs, rules: Rules, span: tuple[date, date] | None, months: Months | None = None
) -> DataFrame:
    """The columns of the planning table that the panel needs, clean.

    Every join of the wide table is a left join on a unique key, so the other parts may be left out.
    """
    wanted = stock.stock_month_end(
        inputs.snapshots, inputs.register, rules.labels, measures=_STOCK_OF_PANEL, span=span,
        sites=inputs.stock_sites, months=months,
    )
    parts = (
        flows.demand_by_product(inputs.sales, rules.since, rules.labels.classes, sites=inputs.sale_sites),
        workshop.workshop_agg_then_join(
            inputs.maintenance, inputs.indicators, rules.since, rules.internal_job, sites=inputs.stock_sites
        ),
    )
    for part in parts:
        wanted = wanted.join(part, ["month_end", "branch"], "left")
    table = wide.planning_table(wanted, segments.branch_segments(inputs.register, rules.rules))
    return panel.clean_wide(
        table.select("month_end", "branch", *STATIC_COLUMNS, *OPERATIONAL_COLUMNS, *SALES_COLUMNS)
    )


def recent_panel(
    inputs: Inputs, rules: Rules, window_months: int, span: tuple[date, date] | None,
    within: Callable[[Months], Inputs] | None = None, until: date | None = None, products: Sequence[str] = PRODUCTS,
) -> DataFrame:
    """The recency window of the dense panel, worked out from the facts of these months alone.

    Equal to taking the window from the whole panel. Which branches there are, and from which month
    to which, comes first, from two columns of the snapshots; only then are the measures read, for
    the window's months. A branch without a row in the window has its series of zeros and the
    attributes that the register gives it. ``until`` ends the panel with that month. ``within``
    narrows the inputs where the caller knows better than ``Inputs.within`` how.
    """
    known = stock.branch_months(inputs.snapshots, inputs.register, span=span, sites=inputs.stock_sites)
    known = materialize(known)
    first, last = known.agg(F.min("first_month"), F.max("last_month")).first()
    if until is not None and last is not None:
        last = min(last, next_month(until) - timedelta(days=1))
    if first is None or last < first:
        return panel.densify(panel.panel_long(panel_wide(inputs, rules, span).limit(0)))
    start = panel.window_start(first, last, window_months)
    months = (start, last)
    narrow = inputs.within(months) if within is None else within(months)
    long = panel.panel_long(materialize(panel_wide(narrow, rules, span, months)))
    geography = segments.branch_segments(inputs.register, rules.rules)
    attributes = (
        known.select("branch")
        .join(inputs.register.select("branch", "country"), "branch")
        .join(geography.select("branch", *[c for c in STATIC_COLUMNS if c != "country"]), "branch", "left")
        .withColumnRenamed("pop_letter", "rank")
    )
    return panel.densify(long, branches=attributes, months=months, products=products)
