from __future__ import annotations

import random

import pytest
from conftest import d, rows, ts
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotcast.config import SegmentRules
from depotcast.contracts import (
    BRANCH_REGISTER,
    DAILY_INDICATOR,
    MAINTENANCE,
    MOVEMENT,
    SALE,
    UNIT_CURRENT,
)
from depotcast.operators import flows, wide, workshop
from depotcast.operators.ranking import with_global_ntile, with_global_row_number
from depotcast.operators.segments import branch_segments


def test_invoiced_units_are_distinct(spark):
    moves = spark.createDataFrame(
        [
            (ts("2024-02-01"), "b", 1, 0), (ts("2024-02-29 23:59"), "b", 1, 0),
            (ts("2024-02-02"), "b", 2, 0), (ts("2024-02-02"), "b", 3, 4),
            (ts("2024-02-02"), "b", None, 0), (ts("2024-03-01"), "b", 1, 0),
            (ts("2024-02-02"), "b", 9, None),
        ],
        MOVEMENT,
    )
    assert rows(flows.invoiced_units(moves)) == [
        dict(month_end=d("2024-02-29"), branch="b", invoiced_units=2),
        dict(month_end=d("2024-03-31"), branch="b", invoiced_units=1),
    ]


def test_produced_units_of_the_registered_branches_of_a_country(spark):
    units = spark.createDataFrame(
        [
            (ts("2024-02-01"), "b", 1), (ts("2024-02-09"), "b", 2), (ts("2024-02-09"), "b", None),
            (ts("2024-02-09"), "abroad", 3), (ts("2024-02-09"), "ghost", 4),
        ],
        UNIT_CURRENT,
    )
    register = spark.createDataFrame(
        [("b", "X", "", "", "", 0, 1), ("abroad", "Y", "", "", "", 0, 1)], BRANCH_REGISTER
    )
    assert rows(flows.produced_units(units, register, "X")) == [
        dict(month_end=d("2024-02-29"), branch="b", produced_units=2)
    ]


def test_demand_counts_ids_since_a_day(spark):
    sales = spark.createDataFrame(
        [
            (ts("2024-01-31 23:00"), "b", 1, "new"), (ts("2024-02-01"), "b", 2, "new"),
            (ts("2024-02-01"), "b", None, "new"), (ts("2024-02-11"), "b", 3, "used"),
            (ts("2024-02-11"), "b", 4, None),
        ],
        SALE,
    )
    assert rows(flows.demand_by_product(sales, d("2024-02-01"))) == [
        dict(month_end=d("2024-02-29"), branch="b", sales_new=1, sales_semi=0, sales_used=1)
    ]


@pytest.fixture()
def fanout(spark):
    jobs = spark.createDataFrame(
        [
            ("b", ts("2024-02-03"), 1, "internal"), ("b", ts("2024-02-04"), 2, "internal"),
            ("b", ts("2024-02-05"), 3, "other"), ("b", ts("2024-02-05"), 4, None),
            ("b", ts("2024-02-05"), None, "internal"),
            ("lonely", ts("2024-02-05"), 5, "internal"),
            # the day itself is not after it
            ("b", ts("2024-01-31 12:00"), 6, "internal"),
        ],
        MAINTENANCE,
    )
    days = spark.createDataFrame(
        [
            ("b", d("2024-02-01"), 1.0, 4.0, 10.0), ("b", d("2024-02-02"), 2.0, None, 20.0),
            ("b", d("2024-02-03"), 6.0, 8.0, 60.0), ("elsewhere", d("2024-02-03"), 9.0, 9.0, 9.0),
        ],
        DAILY_INDICATOR,
    )
    return jobs, days


def test_workshop_counts_each_side_once(fanout):
    got = workshop.workshop_agg_then_join(*fanout, d("2024-01-31"), "internal")
    assert rows(got, "branch") == [
        dict(branch="b", month_end=d("2024-02-29"), maint_internal=2, maint_customer=1,
             mech_total=3.0, mech_present=6.0, mech_on_ramp=30.0),
        dict(branch="lonely", month_end=d("2024-02-29"), maint_internal=1, maint_customer=0,
             mech_total=None, mech_present=None, mech_on_ramp=None),
    ]
    late = workshop.workshop_agg_then_join(
        *fanout, d("2024-01-31"), "internal", indicators_since=d("2024-02-01")
    )
    assert rows(late, "branch")[0]["mech_total"] == 4.0


def test_workshop_pairs_multiply_the_counts(fanout):
    jobs, days = fanout
    got = rows(workshop.workshop_join_then_agg(jobs, days, d("2024-01-31"), "internal"), "branch")
    pairs = (
        jobs.filter(F.col("finished_ts") >= F.lit(d("2024-02-01"))).alias("j")
        .join(
            days.alias("i"),
            (F.col("j.branch") == F.col("i.branch"))
            & (F.last_day("finished_ts") == F.last_day("day")),
            "left",
        )
        .groupBy("j.branch", F.last_day("finished_ts").alias("month_end"))
        .agg(
            F.count(F.when(F.col("job_type") == "internal", F.col("job_id"))).alias("maint_internal"),
            F.count(F.when(F.col("job_type") != "internal", F.col("job_id"))).alias("maint_customer"),
            F.avg("mech_total").alias("mech_total"),
            F.avg("mech_on_ramp").alias("mech_on_ramp"),
        )
    )
    assert got == rows(pairs, "branch")
    assert got[0]["maint_internal"] == 6 and got[1]["maint_internal"] == 1


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (4, 5), (5, 5), (6, 5), (23, 5), (400, 7)])
def test_global_ntile_equals_the_built_in(spark, n, k):
    rng = random.Random(n)
    data = spark.createDataFrame(
        [(rng.randrange(5) if rng.random() < 0.7 else rng.randrange(1000), f"b{i:03d}") for i in range(n)],
        "population long, branch string",
    )
    built_in = data.withColumn("bucket", F.ntile(k).over(Window.orderBy("population", "branch")))
    assert rows(with_global_ntile(data, k, ["population", "branch"])) == rows(built_in)


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    """With and without merging of small partitions: one slice and several."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def test_global_row_number_is_a_rank_without_gaps(spark, coalescing):
    data = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = {r.x: r.row_number for r in with_global_row_number(data, ["x"]).collect()}
    assert [got[x] for x in sorted(got)] == list(range(1, 1001))


def test_global_ntile_over_several_slices(spark, coalescing):
    data = spark.range(403).select((F.col("id") * 31 % 7).alias("population"), F.col("id").alias("branch"))
    built_in = data.withColumn("bucket", F.ntile(5).over(Window.orderBy("population", "branch")))
    assert rows(with_global_ntile(data, 5, ["population", "branch"])) == rows(built_in)


def test_segments_break_ties_by_branch(spark):
    register = spark.createDataFrame(
        [
            ("f", "X", "Port", "S", "s", 0, 5), ("a", "X", "c", "S", "s", 0, 5),
            ("c", "X", "c", "S", "s", 0, 5), ("b", "X", "c", "S", "s", 0, 1),
            ("d", "Y", "Port", "S", "s", 0, 9), ("e", "X", "Port", "N", "s", 0, 7),
            ("g", "X", "c", "S", "s", 0, None),
        ],
        BRANCH_REGISTER,
    )
    rules = SegmentRules(country_overrides={"Y": "all of Y"}, capital_overrides={("S", "Port"): "Port!"})
    got = {r.branch: r for r in branch_segments(register, rules).collect()}
    assert {b: r.pop_bucket for b, r in got.items()} == {"b": 1, "a": 1, "c": 2, "f": 3, "e": 4, "d": 5}
    assert {b: r.pop_letter for b, r in got.items()} == {
        "b": "D", "a": "D", "c": "C", "f": "B", "e": "A", "d": "S",
    }
    assert {b: r.urban_tier for b, r in got.items()} == {
        "b": "interior", "a": "interior", "c": "interior", "f": "regional centre",
        "e": "metropolis", "d": "megacity",
    }
    assert {b: r.region_consolidated for b, r in got.items()} == {
        "a": "S", "b": "S", "c": "S", "d": "all of Y", "e": "N", "f": "Port!",
    }
    # "e" is a city of the capital's name in another region
    assert {b: r.is_capital for b, r in got.items()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 0, "f": 1}


def test_wide_table_keeps_unmatched_months_with_null_flows(spark):
    month = d("2024-02-29")
    stock = spark.createDataFrame(
        [(month, "X", "b", 1), (d("2024-03-31"), "X", "b", 2), (d("2024-04-30"), "X", "b", 3)],
        "month_end date, country string, branch string, rented_total long",
    )
    invoiced = spark.createDataFrame([(month, "b", 4)], "month_end date, branch string, invoiced_units long")
    demand = spark.createDataFrame(
        [(month, "b", 5, 6, 7)],
        "month_end date, branch string, sales_new long, sales_semi long, sales_used long",
    )
    jobs = spark.createDataFrame(
        [(month, "b", 8, 9, 1.0, 2.0)],
        "month_end date, branch string, maint_internal long, maint_customer long, mech_total double, mech_on_ramp double",
    )
    segments = spark.createDataFrame(
        [("b", "A", "r", "tier")], "branch string, pop_letter string, region_consolidated string, urban_tier string"
    )
    got = wide.wide_table(stock, invoiced, demand, jobs, segments, month, d("2024-03-31")).collect()
    assert [(r.month_end, r.invoiced_units, r.sales_used, r.maint_customer, r.pop_letter) for r in got] == [
        (d("2024-03-31"), None, None, None, "A"), (month, 4, 7, 9, "A"),
    ]
