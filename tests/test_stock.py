from __future__ import annotations

import re

import pytest
from conftest import d, rows, ts
from pyspark.sql import functions as F

from depotcast.config import StockLabels
from depotcast.contracts import BRANCH_REGISTER, STOCK_SNAPSHOT
from depotcast.functions.measures import FLOW_MEASURES, quoted, stock_measures
from depotcast.operators import stock

LABELS = StockLabels(
    rented="rented", ready="ready", sale="sale", unavailable="unavailable", total_loss="wreck",
    stolen="stolen", administrative="admin", factory_new="factory", transit_new="transit",
    in_maintenance="in repair", in_transit_new="on its way", received_new="received",
    own_programme=("own a", "own b"), awaiting_auction="auction", between_branches="moving",
    collected="collected", impounded="impounded", misappropriated="kept", operational="yes",
)


def snapshots(spark, *items):
    base = dict(
        snapshot_ts=ts("2024-02-01"), branch="b1", country="X", status_type=None, status_desc=None,
        operational_flag=None, product_rented=None, product_class=None, qty=1,
    )
    return spark.createDataFrame(
        [tuple({**base, **i}[c] for c in STOCK_SNAPSHOT.names) for i in items], STOCK_SNAPSHOT
    )


def register(spark, *items):
    base = dict(
        branch="b1", country="X", city="c", region="r", state="s", third_party=0, population=1
    )
    return spark.createDataFrame(
        [tuple({**base, **i}[c] for c in BRANCH_REGISTER.names) for i in items], BRANCH_REGISTER
    )


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_there_are_32_measures_and_20_of_them_are_flows():
    names = [m.name for m in stock_measures(LABELS)]
    assert len(names) == len(set(names)) == 32
    assert len(FLOW_MEASURES) == len(set(FLOW_MEASURES)) == 20 and set(FLOW_MEASURES) <= set(names)


def test_labels_with_quotes_are_text(spark):
    value = "it's a \\ label"
    assert spark.sql(f"SELECT {quoted(value)} AS x").first().x == value


def test_measures_follow_three_valued_logic(spark):
    facts = snapshots(
        spark,
        # NOT IN on a NULL description is unknown: counted in the total only
        dict(status_type="sale", status_desc=None, qty=5),
        dict(status_type="sale", status_desc="own b", qty=7),
        dict(status_type="sale", status_desc="gift", qty=11),
        dict(status_type="sale", status_desc="auction", qty=13),
        # an unknown status is not "not rented"
        dict(status_type=None, operational_flag="yes", product_class="semi", qty=17),
        dict(status_type="ready", operational_flag="yes", product_class="semi", qty=19),
        dict(status_type="rented", operational_flag="yes", product_class="semi",
             product_rented="used", qty=23),
        dict(status_type="unavailable", status_desc="moving", qty=29),
        dict(status_type="unavailable", status_desc="collected", qty=31),
        dict(status_type="unavailable", status_desc="kept", qty=37),
        dict(status_type="unavailable", status_desc="court", qty=41),
        dict(status_type="unavailable", status_desc=None, qty=43),
    )
    got = one(stock.stock_month_end(facts, register(spark, {}), LABELS))
    expected = {
        "sale_total": 36, "sale_own_programme": 7, "sale_direct_or_donation": 11,
        "sale_awaiting_auction": 13, "operational_total": 59, "operational_semi": 19,
        "operational_new": 0, "rented_total": 23, "rented_used": 23, "rented_semi": 0,
        "ready_semi": 19, "unavailable_between_branches": 60, "unavailable_general": 31 + 37 + 41,
        "unavailable_regulatory": 41, "unavailable_misappropriated": 37, "unavailable_impounded": 0,
        "stolen": 0,
    }
    assert {k: got[k] for k in expected} == expected


def test_month_end_keeps_openings_and_the_latest_day(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-01-31"), status_type="rented", qty=1),
        dict(snapshot_ts=ts("2024-02-01 09:30"), status_type="rented", qty=2),
        dict(snapshot_ts=ts("2024-02-28"), status_type="rented", qty=4),
        dict(snapshot_ts=ts("2024-03-01"), status_type="rented", qty=8),
        dict(snapshot_ts=ts("2024-03-14 06:00"), status_type="rented", qty=16),
        dict(snapshot_ts=ts("2024-03-14 18:00"), status_type="rented", qty=32),
    )
    got = stock.stock_month_end(facts, register(spark, {}), LABELS, measures=["rented_total"])
    assert {r.month_end: r.rented_total for r in got.collect()} == {
        d("2024-01-31"): 2, d("2024-02-29"): 8, d("2024-03-31"): 48,
    }
    openings = stock.stock_month_end(
        facts, register(spark, {}), LABELS, include_latest=False, measures=["rented_total"]
    )
    assert {r.month_end: r.rented_total for r in openings.collect()} == {
        d("2024-01-31"): 2, d("2024-02-29"): 8,
    }


def test_latest_day_that_opens_a_month_counts_for_its_own_month(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-02-01"), status_type="rented", qty=2),
        dict(snapshot_ts=ts("2024-03-01"), status_type="rented", qty=8),
    )
    got = stock.stock_month_end(facts, register(spark, {}), LABELS, measures=["rented_total"])
    assert {r.month_end: r.rented_total for r in got.collect()} == {
        d("2024-01-31"): 2, d("2024-03-31"): 8,
    }


def test_a_known_span_gives_the_same_stock(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-01-01"), status_type="rented", qty=1),
        dict(snapshot_ts=ts("2024-02-01 09:30"), status_type="rented", qty=2),
        dict(snapshot_ts=ts("2024-02-28"), status_type="rented", qty=4),
        dict(snapshot_ts=ts("2024-03-05"), status_type="rented", qty=8),
    )
    span = stock.snapshot_span(facts)
    assert span == (d("2024-01-01"), d("2024-03-05"))
    for latest in (True, False):
        plain = stock.stock_month_end(facts, register(spark, {}), LABELS, include_latest=latest)
        ranged = stock.stock_month_end(
            facts, register(spark, {}), LABELS, include_latest=latest, span=span
        )
        assert rows(plain) == rows(ranged)
    assert rows(stock.company_closed_months(facts, LABELS)) == rows(
        stock.company_closed_months(facts, LABELS, span)
    )


def test_unregistered_branches_fold_into_one_null_branch(spark):
    facts = snapshots(
        spark,
        dict(branch="b1", status_type="rented", qty=1),
        dict(branch="ghost", status_type="rented", qty=2),
        dict(branch="phantom", status_type="rented", qty=4),
    )
    got = stock.stock_month_end(facts, register(spark, {}), LABELS, measures=["rented_total"])
    assert rows(got, "branch") == [
        dict(month_end=d("2024-02-29"), country=None, branch=None, rented_total=6),
        dict(month_end=d("2024-02-29"), country="X", branch="b1", rented_total=1),
    ]


def test_flow_sum_adds_every_snapshot_of_own_branches_of_the_country(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-02-29"), status_type="rented", qty=1),
        # the first of March still describes February
        dict(snapshot_ts=ts("2024-03-01"), status_type="rented", qty=2),
        dict(snapshot_ts=ts("2024-03-02"), status_type="rented", qty=4),
        dict(branch="other", country="Y", status_type="rented", qty=8),
        dict(branch="partner", status_type="rented", qty=16),
        dict(branch="ghost", status_type="rented", qty=32),
    )
    known = register(spark, {}, dict(branch="other", country="Y"), dict(branch="partner", third_party=1))

    def months(*limits):
        got = stock.stock_flow_sum(facts, known, LABELS, "X", *limits)
        return {(r.month_end, r.branch): r.rented_total for r in got.collect()}

    february, march = (d("2024-02-29"), "b1"), (d("2024-03-31"), "b1")
    assert months() == {february: 3, march: 4}
    assert months(february[0], february[0]) == {february: 3}
    assert months(march[0], d("2024-12-31")) == {march: 4}


def test_grid_covers_history_and_twelve_months_for_every_branch(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-01-15"), status_type="sale", qty=3),
        dict(snapshot_ts=ts("2024-02-15"), branch="b2", status_type="ready", qty=5),
        dict(snapshot_ts=ts("2024-03-15"), branch="b2", status_type="sale", qty=7),
        dict(snapshot_ts=ts("2024-02-15"), branch=None, status_type="sale", qty=9),
    )
    got = {(r.branch, r.month_end): (r.sale_total, r.status)
           for r in stock.branch_month_grid(facts, LABELS, d("2024-03-20")).collect()}
    assert len(got) == 2 * 14
    assert got["b1", d("2024-01-31")] == (3, "actual")
    assert got["b1", d("2024-02-29")] == (0, "empty")
    assert got["b2", d("2024-02-29")] == (0, "actual")
    assert got["b2", d("2024-03-31")] == (7, "forecast")
    assert got["b1", d("2025-02-28")] == (0, "forecast")


def test_company_total_stops_before_the_month_of_the_latest_snapshot(spark):
    facts = snapshots(
        spark,
        dict(snapshot_ts=ts("2024-02-28"), status_type="sale", qty=1),
        dict(snapshot_ts=ts("2024-02-28"), branch="b2", status_type="sale", qty=2),
        # 31 March is the month-end of the latest label and not before itself
        dict(snapshot_ts=ts("2024-03-30"), status_type="ready", qty=4),
        dict(snapshot_ts=ts("2024-04-01"), status_type="sale", qty=8),
    )
    got = stock.company_closed_months(facts, LABELS)
    assert [(r.date, r.sale_total, r.status) for r in got.collect()] == [
        (d("2024-02-27"), 3, "actual"), (d("2024-03-29"), 0, "actual"),
    ]


def test_flow_sum_follows_the_country_the_snapshot_states_and_shows_the_registers(spark):
    facts = snapshots(
        spark,
        dict(branch="moved", country="X", status_type="rented", qty=1),
        dict(branch="moved", country="Y", status_type="rented", qty=2),
    )
    known = register(spark, dict(branch="moved", country="Z"))
    got = stock.stock_flow_sum(facts, known, LABELS, "X")
    assert [(r.country, r.branch, r.rented_total) for r in got.collect()] == [("Z", "moved", 1)]


def test_no_snapshots_give_no_stock(spark):
    facts = snapshots(spark)
    assert stock.snapshot_span(facts) is None
    got = stock.stock_month_end(facts, register(spark, {}), LABELS, span=stock.snapshot_span(facts))
    assert got.collect() == []


def test_a_span_that_snapshots_exceed_fails(spark):
    facts = snapshots(spark, dict(status_type="rented"), dict(snapshot_ts=ts("2024-04-01"), status_type="rented"))
    got = stock.stock_month_end(facts, register(spark, {}), LABELS, span=(d("2024-01-01"), d("2024-03-01")))
    with pytest.raises(Exception, match="lies outside"):
        got.collect()


def test_one_month_of_stock_equals_that_month_of_all(spark):
    facts = snapshots(
        spark,
        *[dict(snapshot_ts=ts(x), status_type="rented", qty=2**i)
          for i, x in enumerate(("2024-01-31", "2024-02-01", "2024-02-15", "2024-03-01", "2024-03-14"))],
    )
    known, span = register(spark, {}), stock.snapshot_span(facts)
    everything = rows(stock.stock_month_end(facts, known, LABELS, span=span), "month_end")
    for month in ("2024-01-10", "2024-02-10", "2024-03-10"):
        one_month = rows(stock.stock_month_end(facts, known, LABELS, span=span, month=d(month)))
        assert one_month == [r for r in everything if r["month_end"].month == d(month).month] and one_month


def test_sites_give_the_same_stock_as_branches(spark):
    placed = snapshots(spark, *[dict(branch=b, status_type="rented", qty=q) for b, q in (("b1", 1), ("b1", 2), (None, 4))])
    sited = placed.drop("branch", "country").withColumn("site", F.when(F.col("qty") == 4, 9).otherwise(F.col("qty")))
    sites = spark.createDataFrame([(1, "b1", "X"), (2, "b1", "X"), (3, "b2", "X")], "site long, branch string, country string")
    known = register(spark, {})
    assert rows(stock.stock_month_end(sited, known, LABELS, sites=sites)) == rows(stock.stock_month_end(placed, known, LABELS))
    assert rows(stock.stock_flow_sum(sited, known, LABELS, "X", sites=sites)) == rows(stock.stock_flow_sum(placed, known, LABELS, "X"))


@pytest.mark.parametrize("months", [None, (d("2023-05-01"), d("2024-04-30"))])
def test_rows_meet_the_day_of_the_month_before_the_ranges(spark, months):
    """A row was held against the range of every month before anything cheap had dropped it."""
    kept, _ = stock._labelled_openings(
        snapshots(spark, {}).select("snapshot_ts"), True, (d("2020-01-01"), d("2024-06-15")), months
    )
    plan = kept._jdf.queryExecution().executedPlan().toString()
    condition = next(x for x in plan.splitlines() if "Filter" in x)
    a_range = "snapshot_ts#[0-9]+ >= 2023-07-01 00:00:00"
    assert condition.index("isnotnull(snapshot_ts") < condition.index("dayofmonth(") < re.search(a_range, condition).start()


def test_a_snapshot_without_a_moment_is_in_no_month(spark):
    given = snapshots(spark, {"snapshot_ts": None}, {"snapshot_ts": ts("2024-02-01 07:30")}, {"snapshot_ts": ts("2024-02-03")})
    for months in (None, (d("2024-01-01"), d("2024-01-31"))):
        kept, label = stock._labelled_openings(given, False, (d("2024-01-01"), d("2024-02-03")), months)
        assert [r[0] for r in kept.select(label).collect()] == [d("2024-01-31")]
