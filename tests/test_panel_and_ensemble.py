from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from depotcast.config import EnsembleConfig
from depotcast.contracts import OPERATIONAL_COLUMNS, STATIC_COLUMNS
from depotcast.operators import ensemble, panel, scenarios

WIDE = (
    "month_end date, branch string, "
    + ", ".join(f"{c} {'long' if c == 'population' else 'string'}" for c in STATIC_COLUMNS)
    + ", " + ", ".join(f"{c} double" for c in OPERATIONAL_COLUMNS)
    + ", sales_new long, sales_semi long, sales_used long"
)


def wide_row(day, branch, new=0, city="c", operational=1.0, population=10):
    statics = dict(country="X", state="s", city=city, urban_tier="t", pop_letter="A", population=population)
    return (
        d(day) if day else None, branch, *[statics[c] for c in STATIC_COLUMNS],
        *[operational] * len(OPERATIONAL_COLUMNS), new, new + 1, None,
    )


def make_long(spark, *items):
    return panel.panel_long(panel.clean_wide(spark.createDataFrame(list(items), WIDE)))


def test_clean_drops_rows_without_key_and_snaps_to_month_end(spark):
    raw = spark.createDataFrame(
        [
            wide_row("2024-02-10", "a", operational=None), wide_row("2024-02-29", "b"),
            wide_row(None, "a"), wide_row("2024-02-29", None),
        ],
        WIDE,
    )
    got = panel.clean_wide(raw)
    assert {(r.branch, r.month_end, r.mech_total) for r in got.collect()} == {
        ("a", d("2024-02-29"), 0.0), ("b", d("2024-02-29"), 1.0),
    }


@pytest.fixture(scope="module")
def gap(spark):
    """Branch a skips February and moves city in March; b has all three months."""
    return make_long(
        spark,
        wide_row("2024-01-31", "a", 5, city="old"), wide_row("2024-03-31", "a", 7, city="new"),
        wide_row("2024-01-31", "b", 1), wide_row("2024-02-29", "b", 2), wide_row("2024-03-31", "b", 3),
    )


def test_densify_fills_gaps_and_keeps_the_latest_attributes(gap):
    got = panel.densify(gap)
    assert got.count() == 3 * 2 * 3
    cells = {(r.branch, r["product"], r.date): r for r in got.collect()}
    assert cells["a", "new", d("2024-02-29")].value == 0
    assert cells["a", "new", d("2024-02-29")].ready_total == 0.0
    assert cells["a", "new", d("2024-01-31")].value == 5
    assert cells["a", "semi", d("2024-01-31")].value == 6
    assert cells["a", "used", d("2024-01-31")].value == 0
    assert {r.city for (branch, *_), r in cells.items() if branch == "a"} == {"new"}


def test_strict_static_loses_months_with_other_attributes(gap):
    cells = {(r.branch, r["product"], r.date): r.value for r in panel.densify(gap, strict_static=True).collect()}
    assert cells["a", "new", d("2024-01-31")] == 0 and cells["a", "new", d("2024-03-31")] == 7
    assert cells["b", "new", d("2024-02-29")] == 2


def test_strict_static_matches_missing_attributes(spark):
    long = make_long(spark, wide_row("2024-01-31", "a", 5, city=None, population=None))
    assert {r.value for r in panel.densify(long, strict_static=True).collect()} == {5, 6, 0}


def test_densify_twice_changes_nothing(gap):
    once = panel.densify(gap)
    assert rows(panel.densify(once)) == rows(once)


def test_month_spine_does_not_drift_over_short_months(spark):
    long = make_long(spark, wide_row("2023-11-30", "a"), wide_row("2024-04-30", "a"))
    dates = sorted({r.date for r in panel.densify(long).collect()})
    assert dates == [d(x) for x in (
        "2023-11-30", "2023-12-31", "2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30",
    )]


def test_maturity_bands_and_branches_that_never_sold(spark):
    start = date(2023, 1, 1)
    gaps = {0: "just opened", 59: "just opened", 60: "young", 179: "young", 180: "intermediate",
            359: "intermediate", 360: "mature"}
    data = [(start - timedelta(days=10), "idle", 0)]
    for gap_days in gaps:
        data += [(start, f"b{gap_days}", 1), (start + timedelta(days=gap_days), f"b{gap_days}", 2),
                 (start + timedelta(days=gap_days + 500), f"b{gap_days}", 0)]
    got = {r.branch: r for r in panel.branch_maturity(
        spark.createDataFrame(data, "date date, branch string, value long")).collect()}
    for gap_days, band in gaps.items():
        row = got[f"b{gap_days}"]
        assert (row.days, row.maturity, row.first_date) == (gap_days, band, start)
        assert row.months == gap_days / 30
    assert (got["idle"].days, got["idle"].maturity) == (0, "just opened")
    assert got["idle"].first_date == start - timedelta(days=10)


def test_recency_window_includes_both_ends(spark):
    dates = [d("2024-01-30"), d("2024-01-31"), d("2024-02-01"), d("2026-01-31")]
    data = spark.createDataFrame([(x,) for x in dates], "date date")
    assert sorted(r.date for r in panel.recency_window(data, 24).collect()) == dates[1:]


# --- ensemble -------------------------------------------------------------------------


def naive(values, horizon, window=3, alpha=0.3):
    """The three methods on one list, step by step."""
    n = len(values)
    if n < 2:
        return None
    w = window if n >= window else max(1, n - 1)
    ma = sum(values[-w:]) / w
    level = values[0]
    for v in values[1:]:
        level = alpha * v + (1 - alpha) * level
    mean = sum(values) / n
    if n < 3:
        trend = [mean] * horizon
    else:
        mid = (n - 1) / 2
        slope = sum((i - mid) * (v - mean) for i, v in enumerate(values)) / sum((i - mid) ** 2 for i in range(n))
        trend = [max(0.0, mean + slope * (n + k - mid)) for k in range(horizon)]
    return [(ma, t, level, (ma + t + level) / 3) for t in trend]


def month(i):
    return date(2023 + i // 12, i % 12 + 1, 15)


def wide_of(spark, series):
    data = [
        (month(i), branch, v, 2 * v, 0)
        for branch, values in series.items() for i, v in enumerate(values) if v is not None
    ]
    return spark.createDataFrame(
        data, "month_end date, branch string, rented_new long, rented_semi long, rented_used long"
    )


def test_ensemble_equals_the_step_by_step_methods(spark):
    rng = random.Random(3)
    series = {
        "one": [5], "two": [4, 10], "three": [9, 4, 1], "falling": [90, 60, 20, 1], "flat": [3, 3, 3, 3],
        "long": [rng.randrange(100) for _ in range(20)],
    }
    config = EnsembleConfig(cutoff=d("2024-08-31"))
    got = {}
    for r in ensemble.ensemble_forecast(wide_of(spark, series), config).collect():
        got.setdefault((r.branch, r["product"]), {})[r.period] = (r.ma, r.lr, r.es, r.ensemble)
    assert "one" not in {b for b, _ in got}
    periods = ["2024-09", "2024-10", "2024-11", "2024-12", "2025-01", "2025-02", "2025-03"]
    for branch, values in series.items():
        for product, factor in (("new", 1), ("semi", 2), ("used", 0)):
            want = naive([v * factor for v in values], 7)
            if want is None:
                continue
            assert sorted(got[branch, product]) == periods
            for period, expected in zip(periods, want):
                assert got[branch, product][period] == pytest.approx(expected), (branch, product)
    assert got["falling", "new"]["2024-10"][1] == 0.0


def test_training_stops_at_the_cutoff_and_skipped_months_close_up(spark):
    wide = wide_of(spark, {"b": [4, None, 10, 1, 50]})
    config = EnsembleConfig(cutoff=d("2023-04-30"), horizon=1)
    (closed,) = ensemble.ensemble_forecast(wide, config).filter("product = 'new'").collect()
    assert (closed.ma, closed.lr, closed.es) == pytest.approx(naive([4, 10, 1], 1)[0][:3])
    (filled,) = ensemble.ensemble_forecast(wide, config, calendar=True).filter("product = 'new'").collect()
    assert (filled.ma, filled.lr, filled.es) == pytest.approx(naive([4, 0, 10, 1], 1)[0][:3])
    assert closed.period == "2023-05"


def test_months_of_a_branch_are_added_up_first(spark):
    wide = wide_of(spark, {"b": [4, 6, 8]}).unionAll(wide_of(spark, {"b": [1, 1, 1]}))
    config = EnsembleConfig(cutoff=d("2024-12-31"), horizon=1)
    (row,) = ensemble.ensemble_forecast(wide, config).filter("product = 'new'").collect()
    assert row.ma == 7.0


def test_summary_table_cuts_cells_and_rounds_totals(spark):
    forecast = spark.createDataFrame(
        [("b", "2024-01", "new", 1.6), ("c", "2024-01", "new", 1.1), ("b", "2024-02", "new", 1.9),
         ("b", "2024-02", "used", 0.4)],
        "branch string, period string, product string, ensemble double",
    )
    table = ensemble.ensemble_summary_table(ensemble.ensemble_summary(forecast))
    assert [tuple(r) for r in table.collect()] == [
        ("2024-01", 2, 0, 0), ("2024-02", 1, 0, 0), ("TOTAL", 5, 0, 0),
    ]


def test_scenarios_start_last_year_and_list_branches(spark):
    schema = "date date, branch string, product string, value double"
    actual = spark.createDataFrame(
        [(d("2023-12-31"), "z", "new", 1.0), (d("2024-01-31"), "b", "new", 2.0)], schema)
    forecast = spark.createDataFrame([(d("2025-06-30"), "a", "new", 3.0)], schema)
    both = scenarios.actual_vs_forecast(actual, forecast, d("2025-05-20"))
    assert {(r.branch, r.scenario) for r in both.collect()} == {("b", "actual"), ("a", "forecast")}
    assert [tuple(r) for r in scenarios.branch_choices(both).collect()] == [("a", 1), ("b", 0)]


def test_sum_of_nothing_is_zero(spark):
    wide = spark.createDataFrame(
        [(month(i), "b", None, 1, 1) for i in range(3)],
        "month_end date, branch string, rented_new long, rented_semi long, rented_used long",
    )
    got = ensemble.monthly_series(wide).filter("product = 'new'").agg(F.sum("value")).first()[0]
    assert got == 0.0
