from __future__ import annotations

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from depotcast.operators import reports, rollups

SCHEMA = (
    "month_end date, country string, branch string, city string, region string, "
    "region_consolidated string, state string, pop_letter string, urban_tier string, population {}, "
    "rented_new {}, rented_semi {}, rented_used {}, rented_total {}"
)


def table(spark, items, population="long", measure="long"):
    schema = SCHEMA.format(population, measure, measure, measure, measure)
    return spark.createDataFrame(items, schema)


@pytest.fixture(scope="module")
def wide(spark):
    return table(
        spark,
        [
            (d("2024-01-31"), "X", "a", "ca", "N", "N", "s1", "A", "t1", 100, 1, 2, 3, 6),
            (d("2024-01-31"), "X", "b", "cb", "S", "S", "s2", "B", "t2", 100, 10, None, 30, 40),
            (d("2024-02-29"), "X", "a", "ca", "N", "N", "s1", "A", "t1", 100, 100, 0, 0, 100),
            (d("2024-02-29"), "Y", "c", "cc", None, None, None, None, None, None, 5, 5, 5, 15),
            (d("2024-02-29"), None, None, None, None, None, None, None, None, None, 7, 7, 7, 21),
        ],
    )


def test_long_keeps_every_row_and_zero_fills(wide):
    got = rollups.branch_product_long(wide)
    assert got.count() == 20
    assert dict(got.dtypes)["value"] == "double"
    cell = got.filter("branch = 'b' and product = 'semi'").first()
    assert cell.value == 0.0


def test_text_measures_are_parsed_and_text_that_is_no_number_is_zero(spark):
    text = table(
        spark,
        [
            (d("2024-01-31"), "X", "a", "c", "N", "N", "s", "A", "t", "100", "1.5", "n/a", None, "3"),
            (d("2024-01-31"), "X", "b", "c", "N", "N", "s", "A", "t", "many", "1", "1", "1", "3"),
        ],
        "string", "string",
    )
    values = {(r.branch, r["product"]): r.value for r in rollups.branch_product_long(text).collect()}
    assert values["a", "new"] == 1.5 and values["a", "semi"] == 0.0 and values["a", "used"] == 0.0
    by_population = rollups.rollup(text, ["country", "population"])
    # a population that is no number drops its rows; sums are cut to whole units
    assert {(r.population, r["product"]): r.value for r in by_population.collect()} == {
        (100, "new"): 1, (100, "semi"): 0, (100, "used"): 0, (100, "total"): 3,
    }


def test_rollup_drops_null_keys_and_sums_nulls_to_zero(wide):
    got = {(r.date, r.country, r["product"]): r.value for r in rollups.rollup(wide, ["country"]).collect()}
    assert got[d("2024-01-31"), "X", "semi"] == 2
    assert got[d("2024-02-29"), "Y", "total"] == 15
    assert not any(country is None for _, country, _ in got)
    assert rollups.rollup(wide, ["country", "region", "region_consolidated"]).filter("country = 'Y'").count() == 0


def test_company_rollup_has_a_constant_label_and_all_rows(wide):
    got = rollups.rollup(wide, [], constants={"company": "c"}).filter("product = 'total'")
    assert [(r.date, r.company, r.value) for r in got.collect()] == [
        (d("2024-01-31"), "c", 46), (d("2024-02-29"), "c", 136),
    ]


def test_all_levels_equal_the_single_rollups(wide):
    together = rollups.rollup_all_levels(wide)
    for level, keys in rollups.LEVELS.items():
        single = rollups.rollup(wide, keys)
        part = together.filter(F.col("level") == level).select(single.columns)
        assert rows(part) == rows(single), level


def test_products_add_up_to_the_same_sum_on_every_level(spark):
    full = table(
        spark,
        [
            (d("2024-01-31"), f"c{i % 2}", f"b{i}", f"y{i}", f"r{i % 3}", "rc", f"s{i % 5}", "A", "t",
             i % 4, i, 2 * i, 3 * i, 6 * i)
            for i in range(40)
        ],
    )
    sums = (
        rollups.rollup_all_levels(full).filter("product <> 'total'").groupBy("level").agg(F.sum("value").alias("v"))
    )
    assert {r.v for r in sums.collect()} == {6 * sum(range(40))} and sums.count() == 7


def test_summary_counts_distinct_values(wide):
    got = reports.dataset_summary(rollups.branch_product_long(wide), ["country", "branch", "product"]).first()
    assert got.asDict() == dict(
        n_rows=20, first_date=d("2024-01-31"), last_date=d("2024-02-29"), n_date=2, n_country=2,
        n_branch=3, n_product=4,
    )


def test_totals_top_and_shares(wide):
    long = rollups.branch_product_long(wide)
    assert [(r.branch, r.total) for r in reports.totals_by_key(long, "branch").collect()] == [
        ("a", 106.0), ("b", 40.0), ("c", 15.0),
    ]
    assert [r.branch for r in reports.top_keys(long, ["branch"], 2).collect()] == ["a", "b"]
    assert reports.grand_total(long).first().total == 182.0
    shares = reports.share_by_key(long, "branch").collect()
    assert abs(sum(r.pct for r in shares) - 100) < 1e-9 and abs(shares[0].pct - 10600 / 161) < 1e-9


def test_share_of_nothing_is_zero(wide):
    nothing = rollups.branch_product_long(wide).withColumn("value", F.lit(0.0))
    assert {r.pct for r in reports.share_by_key(nothing, "country").collect()} == {0.0}


def test_per_capita_adds_the_population_of_each_city_once(wide):
    assert [r.asDict() for r in reports.per_capita(wide).collect()] == [
        dict(country="X", value=146, population=200, per_capita=0.73)
    ]


def test_cities_of_one_name_in_two_states_are_two_cities(spark):
    wide = spark.createDataFrame(
        [("X", "s1", "Springfield", 100, 5, 5, 0), ("X", "s2", "Springfield", 300, 10, 0, 0)],
        "country string, state string, city string, population long, rented_new long, rented_semi long, rented_used long",
    )
    assert [r.asDict() for r in reports.per_capita(wide).collect()] == [
        dict(country="X", value=20, population=400, per_capita=0.05)
    ]


def test_branches_of_one_name_in_two_countries_are_ranked_apart(spark):
    long = spark.createDataFrame(
        [("X", "b", "new", 3.0), ("Y", "b", "new", 4.0), ("X", "b", "total", 99.0)],
        "country string, branch string, product string, value double",
    )
    assert [tuple(r) for r in reports.top_keys(long, ["country", "branch"], 10).collect()] == [("Y", "b", 4.0), ("X", "b", 3.0)]


def test_cross_tab_fills_only_on_request(wide):
    long = rollups.branch_product_long(wide).filter("not (branch = 'c' and product = 'semi')")
    plain = {r.branch: r.semi for r in reports.cross_tab(long, "branch").collect()}
    filled = {r.branch: r.semi for r in reports.cross_tab(long, "branch", fill=True).collect()}
    assert plain == {"a": 2.0, "b": 0.0, "c": None} and filled == {"a": 2.0, "b": 0.0, "c": 0.0}


def test_population_list_is_distinct_and_sorted(wide):
    long = rollups.rollup(wide, ["country", "population"])
    assert [tuple(r) for r in reports.population_by_country(long).collect()] == [("X", 100)]


def test_ops_list_skips_missing_columns_and_guards_ratios(spark):
    wide = spark.createDataFrame(
        [
            ("2024-01-31", "a", 3, 4, 8, 2, 1), ("2024-01-31", "b", 9, 1, 0, 0, 0),
            ("not a date", "c", 5, 1, 1, 1, 1), ("2023-01-31", "d", 5, 1, 1, 1, 1),
        ],
        "month_end string, branch string, maint_internal long, rented_total long, "
        "operational_total long, maintenance_total long, ready_total long",
    )
    request = ["branch", "maint_internal", "nowhere"]
    got = reports.ops_list(wide, 2024, 1, request, "maint_internal", ratios=True).collect()
    assert reports.missing_columns(wide, request) == ["nowhere"]
    assert [(r.month_end, r.branch, r.utilisation, r.maintenance_index) for r in got] == [
        (d("2024-01-31"), "b", None, None), (d("2024-01-31"), "a", 0.5, 0.25),
    ]
