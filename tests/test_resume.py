"""Commit log, resumed runs, partitioned facts and the recency window before the work."""

from __future__ import annotations

import os
import re
import signal
import subprocess
import sys
import time
from dataclasses import replace
from datetime import date

import duckdb
import pytest
from conftest import ROOT, rows, ts
from pyspark.sql import functions as F

from depotcast.config import BoostedConfig
from depotcast.functions.dates import MONTH_PARTITION
from depotcast.operators import panel
from depotcast.plans import facts
from depotcast.plans.full_run import Inputs, RunConfig, run
from depotcast.plans.planning import panel_wide, recent_panel
from depotcast.plans.run_log import RunLog, digest
from depotcast.registry import spark_queries
from depotcast.sources import storage
from depotcast.sources import supplied as src

#: The tables that reports and grids add to the wide table, the panel and the forecasts.
PUBLISHED = {
    "wide", "wide_flow", "branch_month_grid", "company_closed_months", "active_restrictions", "branch_product_long", "rollups",
    "rollup_company", "rollup_country", "rollup_region", "rollup_state", "rollup_pop_rank", "rollup_urban", "rollup_population",
    "dataset_summary", "dataset_summary_region", "totals_by_product", "totals_by_country", "totals_by_region_consolidated",
    "totals_by_rank", "totals_by_urban_tier", "share_by_product", "share_by_country", "share_by_rank", "share_by_urban_tier",
    "grand_total", "top_branches", "top_states", "per_capita", "population_by_country", "cross_tab_branch", "cross_tab_country",
    "ops_list", "panel_long", "panel", "branch_maturity", "ensemble_forecast", "ensemble_summary", "ensemble_summary_table",
    "category_codes", "training_rows", "holdout_predictions", "holdout_errors", "holdout_overall", "forecast", "scenarios",
    "scenario_branches", "column_profile",
}


def inputs_of(spark, folder):
    return Inputs(
        src.stock_snapshots(spark, folder), src.branch_register(spark, folder), src.movements(spark, folder),
        src.current_units(spark, folder), src.maintenance(spark, folder), src.daily_indicators(spark, folder),
        src.sales(spark, folder), src.suppliers(spark, folder), src.customers(spark, folder),
        src.unit_history(spark, folder), src.restrictions(spark, folder),
    )


def config_of(output, **changes):
    config = RunConfig(
        labels=src.LABELS, rules=src.RULES, country=src.HOME, since=src.SINCE, internal_job=src.INTERNAL_JOB,
        as_of=src.AS_OF, ensemble=src.ENSEMBLE, output=str(output), boosted=BoostedConfig(trees=2, max_depth=2),
        pending_statuses=src.PENDING_STATUSES, flow_months=(src.FIRST_MONTH, src.LAST_MONTH), ops_month=date(2000, 1, 1),
    )
    return replace(config, **changes)


# the run that is killed, in a session of its own
RUNNER = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
from test_resume import config_of, inputs_of, run
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
run(inputs_of(spark, {folder!r}), config_of({output!r}))
"""


def test_a_killed_run_goes_on_and_changes_redo_what_follows(spark, small, tmp_path):
    out = tmp_path / "out"
    script = RUNNER.format(root=ROOT, tests=os.path.dirname(__file__), folder=small, output=str(out))
    child = subprocess.Popen([sys.executable, "-c", script], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        until = time.time() + 240
        while not (out / "_committed" / "rollup_country.json").exists():
            assert child.poll() is None and time.time() < until
            time.sleep(0.05)
    finally:
        os.killpg(child.pid, signal.SIGKILL)  # the group of the child started here, its JVM included
        child.wait()
    log = RunLog(spark, str(out))
    finished = set(log.stages())
    assert {"wide", "rollups", "rollup_country"} <= finished < PUBLISHED
    # a stage that was killed half-way: files without a marker
    (out / "top_branches").mkdir(exist_ok=True)
    (out / "top_branches" / "part-00000-half.parquet").write_bytes(b"PAR1 half")
    before = {n: (out / "_committed" / f"{n}.json").stat().st_mtime_ns for n in finished}

    logs: list[RunLog] = []
    tables = run(inputs_of(spark, small), config_of(out), logs)
    assert set(tables) == PUBLISHED == set(logs[0].stages())
    assert set(logs[0].skipped) == finished and set(logs[0].done) == PUBLISHED - finished
    assert {n: (out / "_committed" / f"{n}.json").stat().st_mtime_ns for n in finished} == before
    for name, query in {"rollups": "rollup_all_levels", "top_branches": "top_branches", "ops_list": "ops_list",
                        "wide_flow": "wide_table", "active_restrictions": "active_restrictions", "branch_month_grid": "branch_month_grid",
                        "company_closed_months": "company_closed_months", "cross_tab_branch": "cross_tab_branch"}.items():
        direct = spark_queries.QUERIES[query](spark, small)
        rounded = [F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in tables[name].select(direct.columns).dtypes]
        assert rows(tables[name].select(rounded)) == rows(direct), name

    # DuckDB recomputes the error from the written predictions
    con = duckdb.connect()
    (mae,) = con.execute(
        f"SELECT avg(mae) FROM (SELECT avg(abs(actual - predicted)) AS mae FROM '{out}/holdout_predictions/*.parquet' GROUP BY branch, product)"
    ).fetchone()
    assert tables["holdout_overall"].first().mae == pytest.approx(mae, rel=1e-9)
    actual = con.execute(
        f"SELECT count(*) FROM '{out}/holdout_predictions/*.parquet' p JOIN '{out}/training_rows/*.parquet' t USING (branch, product, date) "
        "WHERE t.split = 'holdout' AND abs(p.actual - t.value) < 1e-6"
    ).fetchone()[0]
    assert actual == tables["holdout_predictions"].count() == tables["training_rows"].filter("split = 'holdout'").count()

    # nothing to do
    logs.clear()
    run(inputs_of(spark, small), config_of(out), logs)
    assert logs[0].done == [] and set(logs[0].skipped) == PUBLISHED
    # another model: what predicts with it, and nothing before
    logs.clear()
    run(inputs_of(spark, small), config_of(out, boosted=BoostedConfig(trees=3, max_depth=2)), logs)
    assert set(logs[0].done) == {
        "category_codes", "training_rows", "holdout_predictions", "holdout_errors", "holdout_overall", "forecast", "scenarios",
        "scenario_branches", "column_profile",
    }
    # back to the first model: it is still there
    logs.clear()
    run(inputs_of(spark, small), config_of(out), logs)
    assert "forecast" in logs[0].done and len(storage.names_in(spark, f"{out}/_models/_committed")) == 2


def test_stages_follow_inputs_parameters_and_each_other(spark, tmp_path):
    data = tmp_path / "data"
    spark.range(3).write.parquet(str(data))
    calls: list[str] = []

    def go(parameter=1):
        source = spark.read.parquet(str(data))
        log = RunLog(spark, str(tmp_path / "out"))

        def build(name, df):
            calls.append(name)
            return df

        first = log.table("first", lambda: build("first", source), None, {"data": storage.listing(source)})
        second = log.table("second", lambda: build("second", first.selectExpr(f"id + {parameter} AS x")), parameter, needs=["first"])
        log.table("third", lambda: build("third", second.groupBy().sum()), needs=["second"])
        log.table("apart", lambda: build("apart", spark.range(1)))
        done, calls[:] = list(calls), []
        return done, sorted(r.x for r in second.collect())

    assert go() == (["first", "second", "third", "apart"], [1, 2, 3])
    assert go() == ([], [1, 2, 3])
    assert go(5) == (["second", "third"], [5, 6, 7])
    spark.range(1).write.mode("append").parquet(str(data))
    assert go(5) == (["first", "second", "third"], [5, 5, 6, 7])
    with pytest.raises(KeyError):
        RunLog(spark, str(tmp_path / "out")).table("x", lambda: spark.range(1), needs=["not run yet"])
    assert digest({"a": 1, "b": date(2024, 1, 1)}) == digest({"b": date(2024, 1, 1), "a": 1}) != digest({"a": 1})


def test_a_failed_stage_leaves_no_marker(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    log.table("x", lambda: spark.range(2), 1)
    with pytest.raises(Exception, match="no such day"):
        log.table("x", lambda: spark.range(2).select(F.raise_error(F.lit("no such day"))), 2)
    assert log.committed("x") is None and log.stages() == []
    assert log.table("x", lambda: spark.range(4), 1).count() == 4
    storage.write_text(spark, f"{tmp_path}/_committed/x.json", '{"stage": "x"}')  # of another version
    assert log.committed("x") is None and log.table("x", lambda: spark.range(5), 1).count() == 5


def test_a_span_is_scanned_once_for_a_set_of_files(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path / "facts"), str(tmp_path / "spans")
    spark.createDataFrame([(ts("2024-01-05 10:00"),), (None,)], "at timestamp_ntz").write.parquet(path)
    assert facts.recorded_span(spark.read.parquet(path), "at", root) == (date(2024, 1, 5), date(2024, 1, 5))
    with monkeypatch.context() as m:
        m.setattr(facts, "day_span", lambda *_: pytest.fail("scanned again"))
        assert facts.recorded_span(spark.read.parquet(path), "at", root) == (date(2024, 1, 5), date(2024, 1, 5))
    spark.createDataFrame([(ts("2024-03-01 00:00"),)], "at timestamp_ntz").write.mode("append").parquet(path)
    assert facts.recorded_span(spark.read.parquet(path), "at", root) == (date(2024, 1, 5), date(2024, 3, 1))
    memory = spark.createDataFrame([], "at timestamp_ntz")
    assert facts.recorded_span(memory, "at", root) is None


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.search(r"PartitionFilters: \[(.*?)\], ", x).group(1) for x in plan.splitlines() if "FileScan" in x and "/lineitem-" in x]


@pytest.mark.parametrize("name", ["stock_month_end", "ops_list"])
def test_facts_by_month_are_read_by_partition(spark, small, name):
    by_month = spark_queries.QUERIES[f"{name}_partitioned"](spark, small)
    found = partition_filters(by_month)
    assert found and all(MONTH_PARTITION in x for x in found)
    assert rows(by_month) == rows(spark_queries.QUERIES[name](spark, small))


def test_a_hot_month_and_rows_without_a_moment_are_copied_whole(spark, tmp_path):
    data = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 > 0 THEN timestamp_ntz'2024-02-01 00:00:00' + make_interval(0, 0, 0, cast(id % 28 AS int)) "
        "ELSE timestamp_ntz'2023-01-31 12:00:00' END AS at",
    )
    data.write.parquet(str(tmp_path / "raw"))
    copy = facts.monthly_copy(spark.read.parquet(str(tmp_path / "raw")), "at", "t", str(tmp_path / "copies"))
    assert rows(copy.drop(MONTH_PARTITION)) == rows(data)
    assert {r[0] for r in copy.select(MONTH_PARTITION).distinct().collect()} == {None, date(2024, 2, 1), date(2023, 1, 1)}
    assert copy.filter(F.col(MONTH_PARTITION) != F.trunc("at", "MM")).count() == 0


@pytest.mark.parametrize("until", [None, date(2001, 3, 15), date(1990, 1, 1)])
def test_the_recent_panel_equals_the_window_of_the_whole_one(spark, small, until):
    inputs, rules = inputs_of(spark, small), spark_queries.RULES
    span = facts.day_span(inputs.snapshots, "snapshot_ts")
    whole = panel.densify(panel.panel_long(panel_wide(inputs, rules, span)))
    if until is not None:
        whole = whole.filter(F.col("date") <= F.last_day(F.lit(until)))
    want = panel.recency_window(whole, 24)
    got = recent_panel(inputs, rules, 24, span, until=until)
    assert rows(got.select(want.columns)) == rows(want)


def test_a_branch_and_a_month_without_rows_in_the_window(spark):
    """b2 stops before the window, no snapshot opens one of the window's months."""
    kept = [f"{2020 + m // 12}-{m % 12 + 1:02d}-01" for m in range(48) if m != 40]
    shots = [(ts(x), b, "r", "d", "o", "new", "new", 1) for x in kept for b in ("b1", "b2") if b == "b1" or x < "2021"]
    columns = "snapshot_ts timestamp_ntz, branch string, status_type string, status_desc string, operational_flag string, product_rented string, product_class string, qty long"
    empty = {
        "movements": "moved_ts timestamp_ntz, branch string, unit_id long, prev_status int",
        "units": "created_ts timestamp_ntz, branch string, unit_id long",
        "maintenance": "branch string, finished_ts timestamp_ntz, job_id long, job_type string",
        "indicators": "branch string, day date, mech_total double, mech_present double, mech_on_ramp double",
        "sales": "paid_on timestamp_ntz, branch string, sale_id long, product string",
    }
    register = spark.createDataFrame(
        [("b1", "X", "c1", "r", "s", 0, 10), ("b2", "X", "c2", "r", "s", 0, None)],
        "branch string, country string, city string, region string, state string, third_party int, population long",
    )
    inputs = Inputs(
        spark.createDataFrame(shots, columns).withColumn("country", F.lit("X")), register,
        **{k: spark.createDataFrame([], v) for k, v in empty.items()},
    )
    span = facts.day_span(inputs.snapshots, "snapshot_ts")
    whole = panel.densify(panel.panel_long(panel_wide(inputs, spark_queries.RULES, span)))
    want = panel.recency_window(whole, 24)
    got = recent_panel(inputs, spark_queries.RULES, 24, span)
    assert rows(got.select(want.columns)) == rows(want) and got.count() == 25 * 2 * 3


def test_the_model_reads_the_window_of_the_facts(spark, small):
    """All scans of the facts behind the recent panel, but that of the branch list, have a lower bound in the window."""
    bound = []
    inputs = spark_queries._inputs(spark, small, (date(1999, 11, 30), date(2001, 11, 30)))
    for table, column in ((inputs.sales, "o_orderdate"), (inputs.indicators, "o_orderdate"), (inputs.maintenance, "l_shipdate"), (inputs.snapshots, "l_shipdate")):
        plan = table._jdf.queryExecution().executedPlan().toString()
        (scan,) = [x for x in plan.splitlines() if "FileScan" in x and column in x]
        bound.append(re.search(rf"GreaterThanOrEqual\({column},(\S+?)[T ]", scan).group(1))
    assert set(bound) == {"1999-11-01"}
