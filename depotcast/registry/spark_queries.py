"""Named queries: each runs one operator over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotcast.config import BoostedConfig
from depotcast.contracts import (
    OPERATIONAL_COLUMNS,
    RENTED_COLUMNS,
    SALES_COLUMNS,
    STATIC_COLUMNS,
)
from depotcast.functions.dates import between_days, next_month
from depotcast.functions.numbers import from_log
from depotcast.operators import boosted, ensemble, features, flows, panel, profiles, reports
from depotcast.operators import restrictions as restriction_ops
from depotcast.operators import rollups, scenarios, segments, stock, wide, workshop
from depotcast.plans.facts import monthly_copy, recorded_span
from depotcast.plans.model_store import ModelStore, SavedModel
from depotcast.plans.planning import Inputs, Rules
from depotcast.plans.planning import recent_panel as planned_recent_panel
from depotcast.runtime import materialize, shared_folder
from depotcast.sources import supplied as src

Query = Callable[[SparkSession, str], DataFrame]

MODEL = BoostedConfig()
ENSEMBLE_DIGITS = 4
OPS_YEAR, OPS_MONTH = 2000, 1
OPS_REQUEST = (
    "branch", "maint_internal", "maint_customer", "rented_total", "operational_total",
    "not_collected_yet",
)
PROFILED = src.TABLES
RULES = Rules(src.LABELS, src.RULES, src.HOME, src.SINCE, src.INTERNAL_JOB)


# --- inputs shared by several queries -------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.branch_segments(src.branch_register(spark, d), src.RULES)


def _span(spark: SparkSession, d: str) -> tuple[date, date] | None:
    # scanned for the first query over these files, read from the record by the others
    return recorded_span(src.load(spark, d, "lineitem").select("l_shipdate"), "l_shipdate")


def _inputs(spark: SparkSession, d: str, months: tuple[date, date] | None = None) -> Inputs:
    inputs = Inputs(
        src.stock_snapshots(spark, d), src.branch_register(spark, d), src.movements(spark, d),
        src.current_units(spark, d), src.maintenance(spark, d), src.daily_indicators(spark, d, months),
        src.sales(spark, d), src.suppliers(spark, d), src.customers(spark, d),
    )
    return inputs if months is None else inputs.within(months)


def _stock_month_end(
    spark: SparkSession, d: str, measures=None, month: date | None = None, lineitem: DataFrame | None = None
) -> DataFrame:
    return stock.stock_month_end(
        src.stock_snapshots(spark, d, lineitem), src.branch_register(spark, d), src.LABELS,
        measures=measures, span=_span(spark, d), sites=src.suppliers(spark, d), month=month,
    )


def _stock_flow(spark: SparkSession, d: str, first=None, last=None) -> DataFrame:
    return stock.stock_flow_sum(
        src.stock_snapshots(spark, d), src.branch_register(spark, d), src.LABELS, src.HOME,
        first=first, last=last, sites=src.suppliers(spark, d),
    )


def _demand(spark: SparkSession, d: str) -> DataFrame:
    return flows.demand_by_product(src.sales(spark, d), src.SINCE, sites=src.customers(spark, d))


def _workshop(spark: SparkSession, d: str) -> DataFrame:
    return workshop.workshop_agg_then_join(
        src.maintenance(spark, d), src.daily_indicators(spark, d), src.SINCE, src.INTERNAL_JOB,
        sites=src.suppliers(spark, d),
    )


def _invoiced(spark: SparkSession, d: str) -> DataFrame:
    return flows.invoiced_units(src.movements(spark, d), sites=src.customers(spark, d))


def _produced(spark: SparkSession, d: str) -> DataFrame:
    return flows.produced_units(
        src.current_units(spark, d), src.branch_register(spark, d), src.HOME, sites=src.suppliers(spark, d)
    )


def _wide_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table_snapshot(
        _stock_month_end(spark, d), _invoiced(spark, d), _produced(spark, d), _demand(spark, d),
        _workshop(spark, d),
    )


def _planning(spark: SparkSession, d: str) -> DataFrame:
    return wide.planning_table(_wide_snapshot(spark, d), _segments(spark, d))


# Every join of the wide table is a left join on a unique key, so a query that needs only
# some of its columns may leave the other parts out.


def _rented(spark: SparkSession, d: str) -> DataFrame:
    return _stock_month_end(spark, d, list(RENTED_COLUMNS))


def _rented_by_geography(spark: SparkSession, d: str) -> DataFrame:
    return wide.planning_table(_rented(spark, d), _segments(spark, d))


def _for_panel(spark: SparkSession, d: str) -> DataFrame:
    stock_measures = [c for c in OPERATIONAL_COLUMNS if not c.startswith("mech_")]
    parts = _stock_month_end(spark, d, stock_measures)
    for part in (_demand(spark, d), _workshop(spark, d)):
        parts = parts.join(part, ["month_end", "branch"], "left")
    return wide.planning_table(parts, _segments(spark, d))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    columns = ["month_end", "branch", *STATIC_COLUMNS, *OPERATIONAL_COLUMNS, *SALES_COLUMNS]
    return panel.clean_wide(_for_panel(spark, d).select(*columns))


def _panel_long(spark: SparkSession, d: str) -> DataFrame:
    return panel.panel_long(_clean(spark, d))


def _panel(spark: SparkSession, d: str) -> DataFrame:
    # the panel reads its input four times; the raw tables are read once
    return panel.densify(panel.panel_long(materialize(_clean(spark, d))))


def _recent_panel(spark: SparkSession, d: str) -> DataFrame:
    """The recency window of the panel, from the facts of its months."""
    return planned_recent_panel(
        _inputs(spark, d), RULES, MODEL.window_months, _span(spark, d), within=lambda months: _inputs(spark, d, months)
    )


def _by_month(spark: SparkSession, d: str) -> DataFrame:
    """The shipped lines partitioned by month, written once for a set of files."""
    return monthly_copy(src.load(spark, d, "lineitem"), "l_shipdate", "lineitem")


def _model(spark: SparkSession, d: str) -> tuple[boosted.Training, SavedModel]:
    """The training rows and their model, fitted by whichever query asks first."""
    training = boosted.prepare(_recent_panel(spark, d), MODEL)
    return training, ModelStore(spark, shared_folder(spark, "models")).trained(training)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- queries --------------------------------------------------------------------------


def demand_by_product_month(spark: SparkSession, d: str) -> DataFrame:
    return _demand(spark, d)


def stock_flow_sum(spark: SparkSession, d: str) -> DataFrame:
    return _stock_flow(spark, d)


def stock_month_end(spark: SparkSession, d: str) -> DataFrame:
    return _stock_month_end(spark, d)


def stock_month_start_only(spark: SparkSession, d: str) -> DataFrame:
    return stock.stock_month_end(
        src.stock_snapshots(spark, d), src.branch_register(spark, d), src.LABELS,
        include_latest=False, span=_span(spark, d), sites=src.suppliers(spark, d),
    )


def invoiced_units(spark: SparkSession, d: str) -> DataFrame:
    return _invoiced(spark, d)


def produced_units(spark: SparkSession, d: str) -> DataFrame:
    return _produced(spark, d)


def active_restrictions(spark: SparkSession, d: str) -> DataFrame:
    return restriction_ops.active_restrictions(
        src.unit_history(spark, d), src.restrictions(spark, d), src.PENDING_STATUSES
    )


def workshop_join_then_agg(spark: SparkSession, d: str) -> DataFrame:
    result = workshop.workshop_join_then_agg(
        src.maintenance(spark, d), src.daily_indicators(spark, d), src.SINCE, src.INTERNAL_JOB,
        sites=src.suppliers(spark, d),
    )
    return _rounded(result, 6, "mech_total", "mech_on_ramp")


def workshop_agg_then_join(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_workshop(spark, d), 6, "mech_total", "mech_present", "mech_on_ramp")


def branch_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def wide_table(spark: SparkSession, d: str) -> DataFrame:
    result = wide.wide_table(
        _stock_flow(spark, d, src.FIRST_MONTH, src.LAST_MONTH), _invoiced(spark, d), _demand(spark, d),
        workshop_join_then_agg(spark, d), _segments(spark, d), src.FIRST_MONTH, src.LAST_MONTH,
    )
    return _rounded(result, 6, "mech_total", "mech_on_ramp")


def wide_table_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_wide_snapshot(spark, d), 6, "mech_total", "mech_present", "mech_on_ramp")


def planning_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_planning(spark, d), 6, "mech_total", "mech_present", "mech_on_ramp")


def branch_month_grid(spark: SparkSession, d: str) -> DataFrame:
    return stock.branch_month_grid(
        src.stock_snapshots(spark, d), src.LABELS, src.AS_OF, sites=src.suppliers(spark, d)
    )


def company_closed_months(spark: SparkSession, d: str) -> DataFrame:
    return stock.company_closed_months(
        src.stock_snapshots(spark, d), src.LABELS, span=_span(spark, d)
    )


def _branch_product_long(spark: SparkSession, d: str) -> DataFrame:
    return rollups.branch_product_long(_rented(spark, d))


def _rollup_company(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented(spark, d), [], constants={"company": "company"})


def _rollup_country(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented(spark, d), ["country"])


def _rollup_region(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented_by_geography(spark, d), ["country", "region", "region_consolidated"])


def _rollup_state(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented_by_geography(spark, d), ["country", "state"])


def _rollup_pop_rank(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented_by_geography(spark, d), ["country", "pop_letter"], renamed={"pop_letter": "rank"})


def _rollup_urban(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented_by_geography(spark, d), ["country", "urban_tier"])


def _rollup_population(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup(_rented_by_geography(spark, d), ["country", "population"])


def branch_product_long(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_branch_product_long(spark, d))


def rollup_company(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_company(spark, d))


def rollup_country(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_country(spark, d))


def rollup_region(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_region(spark, d))


def rollup_state(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_state(spark, d))


def rollup_pop_rank(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_pop_rank(spark, d))


def rollup_urban(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_urban(spark, d))


def rollup_population(spark: SparkSession, d: str) -> DataFrame:
    return rollups.in_report_order(_rollup_population(spark, d))


def rollup_all_levels(spark: SparkSession, d: str) -> DataFrame:
    return rollups.rollup_all_levels(_rented_by_geography(spark, d))


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.dataset_summary(_branch_product_long(spark, d), ["country", "branch", "product"])


def dataset_summary_region(spark: SparkSession, d: str) -> DataFrame:
    return reports.dataset_summary(
        _rollup_region(spark, d), ["country", "region", "region_consolidated", "product"]
    )


def totals_by_product(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals_by_key(_rollup_company(spark, d), "product")


def totals_by_country(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals_by_key(_rollup_country(spark, d), "country")


def totals_by_region(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals_by_key(_rollup_region(spark, d), "region_consolidated")


def totals_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals_by_key(_rollup_pop_rank(spark, d), "rank").orderBy("rank")


def totals_by_urban_tier(spark: SparkSession, d: str) -> DataFrame:
    return reports.totals_by_key(_rollup_urban(spark, d), "urban_tier")


def grand_total(spark: SparkSession, d: str) -> DataFrame:
    return reports.grand_total(_rollup_company(spark, d))


def top_branches(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_keys(_branch_product_long(spark, d), ["country", "branch"], 10)


def top_states(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_keys(_rollup_state(spark, d), ["country", "state"], 10)


def _share(long: DataFrame, key: str) -> DataFrame:
    return _rounded(reports.share_by_key(long, key), 6, "pct")


def share_by_product(spark: SparkSession, d: str) -> DataFrame:
    return _share(_rollup_company(spark, d), "product")


def share_by_country(spark: SparkSession, d: str) -> DataFrame:
    return _share(_rollup_country(spark, d), "country")


def share_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return _share(_rollup_pop_rank(spark, d), "rank")


def share_by_urban_tier(spark: SparkSession, d: str) -> DataFrame:
    return _share(_rollup_urban(spark, d), "urban_tier")


def per_capita(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reports.per_capita(_rented_by_geography(spark, d)), 6, "per_capita")


def population_by_country(spark: SparkSession, d: str) -> DataFrame:
    return reports.population_by_country(_rollup_population(spark, d))


def cross_tab_branch(spark: SparkSession, d: str) -> DataFrame:
    return reports.cross_tab(_branch_product_long(spark, d), "branch")


def cross_tab_country(spark: SparkSession, d: str) -> DataFrame:
    return reports.cross_tab(_branch_product_long(spark, d), "country", fill=True)


def _ops_list(spark: SparkSession, d: str, lineitem: DataFrame | None = None) -> DataFrame:
    measures = ["rented_total", "operational_total", "maintenance_total", "ready_total"]
    month = date(OPS_YEAR, OPS_MONTH, 1)
    # one month is wanted: its days are put to each fact table, not to the labels derived from them
    jobs = workshop.workshop_agg_then_join(
        between_days(src.maintenance(spark, d, lineitem), "finished_ts", month, next_month(month)),
        src.daily_indicators(spark, d, (month, month)), src.SINCE, src.INTERNAL_JOB, sites=src.suppliers(spark, d),
    )
    listed = _stock_month_end(spark, d, measures, month, lineitem).join(jobs, ["month_end", "branch"], "left")
    return reports.ops_list(
        listed, OPS_YEAR, OPS_MONTH, OPS_REQUEST, "maint_internal", ratios=True
    )


def ops_list(spark: SparkSession, d: str) -> DataFrame:
    return _ops_list(spark, d)


def ops_list_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return _ops_list(spark, d, _by_month(spark, d))


def stock_month_end_partitioned(spark: SparkSession, d: str) -> DataFrame:
    return _stock_month_end(spark, d, lineitem=_by_month(spark, d))


def clean_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_clean(spark, d), 6, "mech_total", "mech_present")


def panel_long(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_panel_long(spark, d), 6, "mech_total", "mech_present")


def panel_dense(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_panel(spark, d), 6, "mech_total", "mech_present")


def branch_maturity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.branch_maturity(_panel(spark, d)), 6, "months")


def recency_window(spark: SparkSession, d: str) -> DataFrame:
    kept = panel.recency_window(_recent_panel(spark, d), MODEL.window_months)
    return kept.select("date", "branch", "product", "value")


def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    logged = features.log_target(_panel(spark, d))
    return logged.select(
        "date", "branch", "product", "value", F.round("value_log", 6).alias("value_log"),
        from_log(F.col("value_log")).alias("restored"),
    )


def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return features.category_codes(materialize(_recent_panel(spark, d)))


def category_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every label encoded and decoded again from the stored dictionary."""
    recent = materialize(_recent_panel(spark, d))
    codes = materialize(features.category_codes(recent))
    restored = features.encode(recent.select("date", *features.ENCODED_COLUMNS), codes)
    for column in features.ENCODED_COLUMNS:
        restored = features.decode(restored, codes, column)
    return restored.select("date", *features.ENCODED_COLUMNS)


def _whole_doubles_rounded(df: DataFrame) -> DataFrame:
    return _rounded(df, 6, *[c for c, kind in df.dtypes if kind == "double"])


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    recent = materialize(features.log_target(_recent_panel(spark, d)))
    encoded = features.encode(recent, materialize(features.category_codes(recent)))
    return _whole_doubles_rounded(features.lag_features(encoded, MODEL))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the model is trained and tested on: features, target and the part of each row."""
    training = boosted.prepare(_recent_panel(spark, d), MODEL)
    return _whole_doubles_rounded(boosted.training_table(training))


def future_covariates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(
        features.future_covariates(materialize(_panel(spark, d)), MODEL.horizon), 6,
        "mech_total", "mech_present",
    ).withColumn("month_number", F.col("month_number").cast("long"))


def gbt_holdout_mae(spark: SparkSession, d: str) -> DataFrame:
    training, model = _model(spark, d)
    return boosted.overall_error(boosted.holdout_errors(model.trees, training))


def gbt_forecast_12m(spark: SparkSession, d: str) -> DataFrame:
    training, model = _model(spark, d)
    return boosted.recursive_forecast(model.trees, training)


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.ensemble_forecast(_rented(spark, d), src.ENSEMBLE)


def ensemble_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ensemble(spark, d), ENSEMBLE_DIGITS, "ma", "lr", "es", "ensemble")


def ensemble_calendar(spark: SparkSession, d: str) -> DataFrame:
    result = ensemble.ensemble_forecast(
        materialize(_rented(spark, d).select("month_end", "branch", "rented_new", "rented_semi", "rented_used")),
        src.ENSEMBLE, calendar=True,
    )
    return _rounded(result, ENSEMBLE_DIGITS, "ma", "lr", "es", "ensemble")


def ensemble_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ensemble.ensemble_summary(_ensemble(spark, d)), ENSEMBLE_DIGITS, "total")


def ensemble_summary_table(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.ensemble_summary_table(ensemble.ensemble_summary(_ensemble(spark, d)))


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    rented = materialize(
        _rented(spark, d).select("month_end", "branch", "rented_new", "rented_semi", "rented_used")
    )
    actual = rollups.to_products(
        rented.filter(F.col("branch").isNotNull()).withColumnRenamed("month_end", "date"),
        ["date", "branch"],
        {"rented_new": "new", "rented_semi": "semi", "rented_used": "used"},
    )
    forecast = ensemble.ensemble_forecast(rented, src.ENSEMBLE).select(
        F.last_day(F.to_date("period", "yyyy-MM")).alias("date"), "branch", "product",
        F.round("ensemble", ENSEMBLE_DIGITS).alias("value"),
    )
    return scenarios.actual_vs_forecast(actual, forecast, src.AS_OF)


def actual_vs_forecast(spark: SparkSession, d: str) -> DataFrame:
    return _scenarios(spark, d)


def scenario_branches(spark: SparkSession, d: str) -> DataFrame:
    return scenarios.branch_choices(_scenarios(spark, d))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    found = profiles.column_profile({t: src.load(spark, d, t) for t in PROFILED}, exact=True)
    # the text of a floating-point number differs between engines; with six decimals it does not
    floating = F.col("data_type").isin("double", "float")
    shown = found.withColumns({
        f"{f}_value": F.when(floating, F.col(f"{f}_number").cast("decimal(38,6)").cast("string")).otherwise(F.col(f"{f}_value"))
        for f in ("min", "max")
    })
    longest = F.greatest(F.length("min_value"), F.length("max_value")).cast("long")
    return shown.withColumn("max_text_length", F.when(floating, longest).otherwise(F.col("max_text_length")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        demand_by_product_month, stock_flow_sum, stock_month_end, stock_month_start_only,
        invoiced_units, produced_units, active_restrictions, workshop_join_then_agg,
        workshop_agg_then_join, branch_segments, wide_table, wide_table_snapshot, planning_table,
        branch_month_grid, company_closed_months, branch_product_long, rollup_company,
        rollup_country, rollup_region, rollup_state, rollup_pop_rank, rollup_urban,
        rollup_population, rollup_all_levels, dataset_summary, dataset_summary_region,
        totals_by_product, totals_by_country, totals_by_region, totals_by_rank,
        totals_by_urban_tier, grand_total, top_branches, top_states, share_by_product,
        share_by_country, share_by_rank, share_by_urban_tier, per_capita, population_by_country,
        cross_tab_branch, cross_tab_country, ops_list, ops_list_partitioned,
        stock_month_end_partitioned, clean_wide, panel_long, panel_dense,
        branch_maturity, recency_window, log_roundtrip, category_codes, category_roundtrip, lag_features,
        training_rows, future_covariates, gbt_holdout_mae, gbt_forecast_12m, ensemble_forecast,
        ensemble_calendar, ensemble_summary, ensemble_summary_table, actual_vs_forecast,
        scenario_branches, column_profile,
    )
}
