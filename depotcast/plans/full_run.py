"""One run from the logical inputs to every published table, that goes on where an earlier one stopped.

Each stage writes Parquet and the next one starts from the written table, so the raw inputs are
scanned once. A commit log (``run_log``) says which stages are finished for the present inputs and
parameters: those are read back, the others are made, in order. The first error stops the run and
leaves the finished stages in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotcast.config import BoostedConfig, EnsembleConfig, SegmentRules, StockLabels
from depotcast.functions.dates import MONTH_PARTITION
from depotcast.operators import boosted, ensemble, panel, profiles, reports, restrictions, rollups, scenarios
from depotcast.operators import stock
from depotcast.plans.facts import by_month, recorded_span
from depotcast.plans.model_store import ModelStore, SavedModel
from depotcast.plans.planning import Inputs, Rules, build_flow_wide, build_wide
from depotcast.plans.run_log import RunLog
from depotcast.sources import storage
from depotcast.sources.files import write_csv

__all__ = ["Inputs", "RunConfig", "run"]

#: The inputs that the planning table and the panel are made of.
_FACTS = ("snapshots", "register", "movements", "units", "maintenance", "indicators", "sales", "stock_sites", "sale_sites")
_STOCK = ("snapshots", "register", "stock_sites")


@dataclass(frozen=True)
class RunConfig:
    labels: StockLabels
    rules: SegmentRules
    country: str
    since: date
    internal_job: str
    as_of: date
    ensemble: EnsembleConfig
    output: str
    boosted: BoostedConfig = field(default_factory=BoostedConfig)
    csv: bool = False
    # if given, the model does not see later months (the last one that every source covers)
    last_closed: date | None = None
    # the statuses whose units are counted by the restrictions on them
    pending_statuses: Sequence[int] = ()
    # months of the flow-sum wide table; without them it is not published
    flow_months: tuple[date, date] | None = None
    # a day of the month to list operations of, the columns to list and the one to sort by
    ops_month: date | None = None
    ops_columns: Sequence[str] = ("branch", "maint_internal", "maint_customer", "rented_total", "operational_total")
    ops_sort: str = "maint_internal"
    # keep a copy of the snapshots partitioned by month and read stock from it
    partition_snapshots: bool = False

    @property
    def planning(self) -> Rules:
        return Rules(self.labels, self.rules, self.country, self.since, self.internal_job)


class _Run:
    """Stages in the order in which they are asked for."""

    def __init__(self, spark: SparkSession, inputs: Inputs, config: RunConfig):
        self.inputs, self.config = inputs, config
        self.log = RunLog(spark, config.output)
        self.written: dict[str, DataFrame] = {}
        self._listed: dict[str, str] = {}

    def listings(self, names: Sequence[str]) -> dict[str, str]:
        """What the files of the named inputs are, and their columns; looked up once a run."""
        for name in names:
            table = getattr(self.inputs, name)
            if name not in self._listed and table is not None:
                self._listed[name] = f"{storage.listing(table)} {table.schema.simpleString()}"
        return {n: self._listed[n] for n in names if n in self._listed}

    def table(
        self, name: str, build: Callable[[], DataFrame], parameters: Any = None, needs: Sequence[str] = (),
        inputs: Sequence[str] = (), published: bool = True, partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        csv = self.config.csv and published

        def publish(df: DataFrame) -> None:
            if csv:
                write_csv(df, f"{self.config.output}/csv/{name}")

        table = self.log.table(name, build, [parameters, csv], self.listings(inputs), needs, publish, partition_by)
        if published:
            self.written[name] = table
        return table


def run(inputs: Inputs, config: RunConfig, log: list[RunLog] | None = None) -> dict[str, DataFrame]:
    """Build and write every table that is not finished; returns the written tables by name.

    ``log``, if given, receives the run's commit log, which names the stages made and skipped.
    """
    at = _Run(inputs.register.sparkSession, inputs, config)
    if log is not None:
        log.append(at.log)
    rules = config.planning
    stock.check_inputs(inputs.snapshots, inputs.register, inputs.stock_sites)

    # the days of the snapshots are on record per set of files; looked up when a stage first needs them
    spans: list = []

    def span() -> tuple[date, date] | None:
        if not spans:
            spans.append(recorded_span(inputs.snapshots, "snapshot_ts", f"{config.output}/_spans"))
        return spans[0]

    facts, needed = inputs, []
    if config.partition_snapshots:
        def copy() -> DataFrame:
            return by_month(inputs.snapshots, "snapshot_ts")

        copied = at.table("snapshots_by_month", copy, None, (), ("snapshots",), False, (MONTH_PARTITION,))
        facts, needed = replace(inputs, snapshots=copied), ["snapshots_by_month"]

    table = at.table("wide", lambda: build_wide(facts, rules, span()), rules, needed, _FACTS)
    if config.flow_months is not None:
        at.table(
            "wide_flow", lambda: build_flow_wide(facts, rules, *config.flow_months),
            [rules, config.flow_months], needed, _FACTS,
        )
    at.table(
        "branch_month_grid",
        lambda: stock.branch_month_grid(facts.snapshots, config.labels, config.as_of, sites=inputs.stock_sites),
        [config.labels, config.as_of], needed, _STOCK,
    )
    at.table(
        "company_closed_months", lambda: stock.company_closed_months(facts.snapshots, config.labels, span=span()),
        config.labels, needed, _STOCK,
    )
    if inputs.unit_history is not None and inputs.restrictions is not None:
        statuses = list(config.pending_statuses)
        at.table(
            "active_restrictions",
            lambda: restrictions.active_restrictions(inputs.unit_history, inputs.restrictions, statuses),
            statuses, (), ("unit_history", "restrictions"),
        )

    # rollups and reports
    branch = at.table(
        "branch_product_long", lambda: rollups.in_report_order(rollups.branch_product_long(table)), needs=["wide"]
    )
    at.table("rollups", lambda: rollups.rollup_all_levels(table), needs=["wide"])
    levels: dict[str, tuple] = {
        "rollup_company": ([], {"company": "company"}, None), "rollup_country": (["country"], None, None),
        "rollup_region": (["country", "region", "region_consolidated"], None, None),
        "rollup_state": (["country", "state"], None, None),
        "rollup_pop_rank": (["country", "pop_letter"], None, {"pop_letter": "rank"}),
        "rollup_urban": (["country", "urban_tier"], None, None),
        "rollup_population": (["country", "population"], None, None),
    }
    for name, (keys, constants, renamed) in levels.items():
        at.table(
            name, lambda k=keys, c=constants, r=renamed: rollups.in_report_order(rollups.rollup(table, k, constants=c, renamed=r)),
            [keys, constants, renamed], ["wide"],
        )
    made = at.written
    summaries = {
        "dataset_summary": (branch, "branch_product_long", ["country", "branch", "product"]),
        "dataset_summary_region": (made["rollup_region"], "rollup_region", ["country", "region", "region_consolidated", "product"]),
    }
    for name, (long, source, keys) in summaries.items():
        at.table(name, lambda x=long, k=keys: reports.dataset_summary(x, k), keys, [source])
    keyed = {
        "product": "rollup_company", "country": "rollup_country", "region_consolidated": "rollup_region",
        "rank": "rollup_pop_rank", "urban_tier": "rollup_urban",
    }
    for key, source in keyed.items():
        at.table(f"totals_by_{key}", lambda x=made[source], k=key: reports.totals_by_key(x, k), key, [source])
        if key != "region_consolidated":
            at.table(f"share_by_{key}", lambda x=made[source], k=key: reports.share_by_key(x, k), key, [source])
    at.table("grand_total", lambda: reports.grand_total(made["rollup_company"]), needs=["rollup_company"])
    at.table("top_branches", lambda: reports.top_keys(branch, ["country", "branch"]), needs=["branch_product_long"])
    at.table("top_states", lambda: reports.top_keys(made["rollup_state"], ["country", "state"]), needs=["rollup_state"])
    at.table("per_capita", lambda: reports.per_capita(table), needs=["wide"])
    at.table(
        "population_by_country", lambda: reports.population_by_country(made["rollup_population"]), needs=["rollup_population"]
    )
    at.table("cross_tab_branch", lambda: reports.cross_tab(branch, "branch"), needs=["branch_product_long"])
    at.table("cross_tab_country", lambda: reports.cross_tab(branch, "country", fill=True), needs=["branch_product_long"])
    if config.ops_month is not None:
        day, columns = config.ops_month, list(config.ops_columns)
        at.table(
            "ops_list",
            lambda: reports.ops_list(table, day.year, day.month, columns, config.ops_sort, ratios=True),
            [day, columns, config.ops_sort], ["wide"],
        )

    # panel and forecasts
    long = at.table("panel_long", lambda: panel.panel_long(panel.clean_wide(table)), needs=["wide"])
    dense = at.table("panel", lambda: panel.densify(long), needs=["panel_long"])
    at.table("branch_maturity", lambda: panel.branch_maturity(dense), needs=["panel"])
    by_method = at.table(
        "ensemble_forecast", lambda: ensemble.ensemble_forecast(table, config.ensemble), config.ensemble, ["wide"]
    )
    at.table("ensemble_summary", lambda: ensemble.ensemble_summary(by_method), needs=["ensemble_forecast"])
    at.table(
        "ensemble_summary_table", lambda: ensemble.ensemble_summary_table(ensemble.ensemble_summary(by_method)),
        needs=["ensemble_forecast"],
    )

    # one fit serves the holdout and the forecast; prepared only if one of them has to be made
    fitted: list[tuple[boosted.Training, SavedModel]] = []

    def model() -> tuple[boosted.Training, SavedModel]:
        if not fitted:
            seen = dense if config.last_closed is None else dense.filter(F.col("date") <= F.lit(config.last_closed))
            training = boosted.prepare(seen, config.boosted)
            fitted.append((training, ModelStore(at.log.spark, f"{config.output}/_models").trained(training)))
        return fitted[0]

    shape = [config.boosted, config.last_closed]
    at.table("category_codes", lambda: model()[1].codes, shape, ["panel"])
    at.table("training_rows", lambda: boosted.training_table(model()[0]), shape, ["panel"])
    predictions = at.table(
        "holdout_predictions", lambda: boosted.holdout_predictions(model()[1].trees, model()[0]), shape, ["panel"]
    )
    errors = at.table("holdout_errors", lambda: boosted.series_errors(predictions), needs=["holdout_predictions"])
    at.table("holdout_overall", lambda: boosted.overall_error(errors), needs=["holdout_errors"])
    forecast = at.table("forecast", lambda: boosted.recursive_forecast(model()[1].trees, model()[0]), shape, ["panel"])
    at.table(
        "scenarios", lambda: scenarios.actual_vs_forecast(dense, forecast, config.as_of), config.as_of, ["panel", "forecast"]
    )
    at.table("scenario_branches", lambda: scenarios.branch_choices(made["scenarios"]), needs=["scenarios"])

    # what was published, column by column
    published = {n: t for n, t in made.items() if n in ("wide", "branch_product_long", "rollups", "panel", "forecast")}
    at.table("column_profile", lambda: profiles.column_profile(published), needs=list(published))
    return at.written
