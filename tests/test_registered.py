"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import re

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from depotcast.registry.oracle_queries import ORACLE as OWN_ORACLE
from depotcast.registry.spark_queries import QUERIES as OWN_QUERIES

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()
MODEL_ONLY = {"gbt_holdout_mae", "gbt_forecast_12m"}


@pytest.fixture(scope="session")
def duck(small):
    return connect(small)


def test_only_the_model_has_no_sql():
    assert set(OWN_QUERIES) - set(OWN_ORACLE) == MODEL_ONLY and set(ORACLE) <= set(QUERIES)
    assert set(OWN_QUERIES) <= set(QUERIES) and set(OWN_ORACLE) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toArrow()
    want = duck.sql(ORACLE[name]).to_arrow_table()
    assert got.num_rows > 0
    assert differences(got, want) == []


@pytest.mark.parametrize("name", sorted(MODEL_ONLY))
def test_model_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_has_a_stable_schema(spark):
    result = contract.entry(spark)
    assert dict(result.dtypes) == {
        "month_end": "date", "branch": "string", "sales_new": "bigint", "sales_semi": "bigint",
        "sales_used": "bigint",
    }
    assert result.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# column_profile only repeats one-column scans; the model queries end in a scan of a written state
PLANNED = sorted(set(OWN_QUERIES) - MODEL_ONLY - {"column_profile"})


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_joins_and_no_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_demand_reads_four_columns_and_pushes_the_day(spark, small):
    plan = plan_of(QUERIES["demand_by_product_month"](spark, small))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "orders.parquet" in x)
    assert "GreaterThanOrEqual(o_orderdate" in scan
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"}


def test_raw_facts_are_aggregated_before_they_are_shuffled(spark, small):
    """Between the scan of the facts and the first exchange sits a partial aggregate."""
    plan = plan_of(QUERIES["stock_flow_sum"](spark, small)).splitlines()
    exchange = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(_groupingexpression" in x or "Exchange hashpartitioning(month_end" in x)
    assert "partial_sum" in plan[exchange + 1]


def test_month_end_stock_pushes_the_days_it_keeps(spark, small):
    plan = plan_of(QUERIES["stock_month_end"](spark, small))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "lineitem.parquet" in x)
    assert re.search(r"PushedFilters: \[(IsNotNull\(l_shipdate\), )?(Or\()+", scan)
