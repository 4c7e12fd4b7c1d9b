from __future__ import annotations

import shutil

import pytest
from conftest import d, rows, ts
from pyspark.sql import functions as F

from depotcast import contracts
from depotcast.config import BoostedConfig
from depotcast.operators import profiles
from depotcast.operators.profiles import catalog_columns, column_profile
from depotcast.plans.full_run import Inputs, RunConfig, run
from depotcast.registry.spark_queries import QUERIES
from depotcast.runtime import ensure_checkpoint_dir
from depotcast.sources import files
from depotcast.sources import supplied as src


def test_csv_with_bom_is_read_by_name_and_parsed_to_the_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿branch,extra,day,mech_total,mech_present,mech_on_ramp\nb,x,2024-01-31,1.5,oops,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("branch,extra,day,mech_total,mech_present,mech_on_ramp\nc,x,never,2,3,4\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "*.csv"), contracts.DAILY_INDICATOR)
    assert got.schema == contracts.DAILY_INDICATOR
    assert rows(got, "branch") == [
        dict(branch="b", day=d("2024-01-31"), mech_total=1.5, mech_present=None, mech_on_ramp=None),
        dict(branch="c", day=None, mech_total=2.0, mech_present=3.0, mech_on_ramp=4.0),
    ]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="sales lacks column.*sale_id, product"):
        contracts.conform(spark.createDataFrame([(ts("2024-01-01"), "b")], "paid_on timestamp_ntz, branch string"), contracts.SALE, "sales")


def test_sql_takes_named_parameters(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT id FROM range(10) WHERE id >= :least", encoding="utf-8")
    assert files.run_sql_file(spark, str(path), {"least": 8}).count() == 2


def test_written_tables_are_read_back(spark, tmp_path):
    data = spark.createDataFrame([(1, "a"), (2, "b")], "x long, k string")
    assert rows(files.write_parquet(data, str(tmp_path / "p"))) == rows(data)
    assert rows(files.write_parquet(data, str(tmp_path / "q"), ("k",))) == rows(data)
    files.write_csv(data, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).count() == 2


def test_checkpoint_folder_follows_the_session(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert before and spark.sparkContext.getCheckpointDir() == before


def test_profile_of_values_and_approximate_counts(spark):
    data = spark.createDataFrame(
        [(1, "bb", 0.0, [1], None), (1, None, None, None, None), (3, "a", -2.0, [2], None), (3, "a", -0.0, [2], None)],
        "n int, s string, x double, v array<int>, e date",
    )
    want = {
        "n": ("int", 0, "1", "3", 1, 2), "s": ("string", 1, "a", "bb", 2, 2),
        "x": ("double", 1, "-2.0", "0.0", 4, 2), "v": ("array<int>", 1, None, None, None, 2),
        "e": ("date", 4, None, None, None, 0),
    }
    for exact in (True, False):
        got = column_profile({"t": data}, exact=exact)
        assert {
            r.column_name: (r.data_type, r.null_count, r.min_value, r.max_value, r.max_text_length, r.distinct_count)
            for r in got.collect()
        } == want
        assert [r.ordinal for r in got.collect()] == [1, 2, 3, 4, 5]


def test_extremes_of_doubles_are_whole(spark):
    data = spark.createDataFrame([(1e30,), (1e-9,), (-1e30,)], "x double")
    (got,) = column_profile({"t": data}, exact=True).collect()
    assert (got.min_number, got.max_number) == (-1e30, 1e30) and (float(got.min_value), float(got.max_value)) == (-1e30, 1e30)


def test_approximate_counts_are_near_the_exact_ones(spark):
    data = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.col("id").cast("string").alias("s"))
    exact, near = ({r.column_name: r.distinct_count for r in column_profile({"t": data}, exact=e).collect()} for e in (True, False))
    assert exact == {"k": 5000, "s": 20000} and all(abs(near[c] - n) <= 0.15 * n for c, n in exact.items())


def test_exact_counts_do_not_depend_on_the_columns_taken_together(spark, monkeypatch):
    data = spark.range(50).selectExpr("id", "id % 7 AS k", "cast(id % 3 AS string) AS s", "array(id % 2) AS v", "cast(null AS date) AS e")
    counts = []
    for columns in (1, 2, 9):
        monkeypatch.setattr(profiles, "COLUMNS_AT_ONCE", columns)
        counts.append([r.distinct_count for r in column_profile({"t": data}, exact=True).collect()])
    assert counts == [[50, 7, 3, 2, 0]] * 3


def test_parts_merge_without_reading_them_again(spark, tmp_path):
    def part(first, last):
        return spark.range(first, last).selectExpr(
            "id", "cast(id % 9000 AS string) AS s", "CASE WHEN id % 5 > 0 THEN cast(id % 100 AS double) / 8 END AS x",
            "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 400 AS int)) AS t", "id % 2 = 0 AS b",
            "array(id % 3) AS v", "cast(id % 11 AS decimal(12,2)) AS d", "cast(null AS date) AS e", "cast(id % 6 AS tinyint) AS i",
        )

    whole = part(0, 40000)
    for name, (first, last) in {"1": (0, 25000), "2": (20000, 40000)}.items():  # 5000 rows are in both
        part(first, last).write.parquet(str(tmp_path / "data" / name))
        kept = spark.read.parquet(str(tmp_path / "data" / name))
        profiles.profile_part({"t": kept}).write.parquet(str(tmp_path / "profile" / f"part={name}"))
    shutil.rmtree(tmp_path / "data")  # the merge has the parts' profiles alone
    got = {r.column_name: r for r in profiles.merged_profile(spark.read.parquet(str(tmp_path / "profile"))).collect()}
    want = {r.column_name: r for r in column_profile({"t": whole}, exact=True).collect()}
    assert list(got) == list(want)
    for name, r in got.items():
        w = want[name]
        assert (r.ordinal, r.data_type, r.n_rows) == (w.ordinal, w.data_type, 45000)
        assert abs(r.distinct_count - w.distinct_count) <= profiles.SKETCH_TOLERANCE * w.distinct_count
        if name != "d":  # shown with 18 decimals
            assert (r.min_value, r.max_value, r.max_text_length) == (w.min_value, w.max_value, w.max_text_length)
    assert got["x"].null_count == 9000 and got["e"].null_count == 45000 and got["d"].max_value.startswith("10.0")


def test_sketches_stay_within_the_stated_tolerance(spark):
    for n in (10, 3000, 100_000, 2_000_000):
        data = spark.range(2 * n).selectExpr(f"id % {n} AS k", f"concat('k', id % {n}) AS s")
        for r in profiles.merged_profile(profiles.profile_part({"t": data})).collect():
            assert abs(r.distinct_count - n) <= profiles.SKETCH_TOLERANCE * n


def test_catalogue_lists_columns_in_order(spark):
    spark.createDataFrame([(1, "a")], "n int, s string").createOrReplaceTempView("listed_here")
    got = [tuple(r) for r in catalog_columns(spark).where("table_name = 'listed_here'").collect()]
    assert got == [(None, "listed_here", "n", 1, "int"), (None, "listed_here", "s", 2, "string")]


def test_full_run_writes_every_table(spark, small, tmp_path):
    inputs = Inputs(
        src.stock_snapshots(spark, small), src.branch_register(spark, small), src.movements(spark, small),
        src.current_units(spark, small), src.maintenance(spark, small), src.daily_indicators(spark, small),
        src.sales(spark, small), stock_sites=src.suppliers(spark, small), sale_sites=src.customers(spark, small),
    )
    config = RunConfig(
        labels=src.LABELS, rules=src.RULES, country=src.HOME, since=src.SINCE, internal_job=src.INTERNAL_JOB,
        as_of=src.AS_OF, ensemble=src.ENSEMBLE, output=str(tmp_path),
        boosted=BoostedConfig(trees=2, max_depth=2), csv=True,
    )
    tables = run(inputs, config)
    for name, table in tables.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == table.count() > 0
        assert (tmp_path / "csv" / name / "_SUCCESS").exists()
    direct = QUERIES["rollup_all_levels"](spark, small)
    assert rows(tables["rollups"].select(direct.columns)) == rows(direct)
    assert {r.scenario for r in tables["scenarios"].select("scenario").distinct().collect()} == {"actual", "forecast"}


def test_full_run_stops_at_the_first_error(spark, small, tmp_path):
    inputs = Inputs(*[src.sales(spark, small).withColumnRenamed("paid_on", "snapshot_ts")] * 7)
    config = RunConfig(
        labels=src.LABELS, rules=src.RULES, country=src.HOME, since=src.SINCE, internal_job=src.INTERNAL_JOB,
        as_of=src.AS_OF, ensemble=src.ENSEMBLE, output=str(tmp_path),
    )
    with pytest.raises(ValueError, match="stock snapshots lacks column"):
        run(inputs, config)
    assert not list(tmp_path.iterdir())
