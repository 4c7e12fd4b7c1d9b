"""Plans and results without broadcasts, and with one supplier and one customer that hold a third of all rows."""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from compare import connect, differences

from depotcast.registry.oracle_queries import ORACLE
from depotcast.registry.spark_queries import QUERIES

#: One query of each way in which facts are reduced, joined and ranked.
KINDS = (
    "stock_flow_sum", "stock_month_end", "invoiced_units", "produced_units", "demand_by_product_month", "active_restrictions",
    "workshop_join_then_agg", "branch_segments", "branch_month_grid", "rollup_all_levels", "recency_window", "ensemble_forecast",
)


@pytest.fixture(scope="module")
def hot(small, tmp_path_factory):
    """The small tables, with one supplier and one customer behind a third of the facts."""
    folder = tmp_path_factory.mktemp("hot")
    for name in os.listdir(small):
        table = pq.read_table(f"{small}/{name}")
        for column in ("l_suppkey", "o_custkey"):
            if column in table.column_names:
                third = pc.equal(pc.subtract(pa.array(range(table.num_rows)), pc.multiply(pc.divide(pa.array(range(table.num_rows)), 3), 3)), 0)
                at = table.column_names.index(column)
                table = table.set_column(at, table.schema.field(column), pc.if_else(third, pa.scalar(1, table.column(column).type), table.column(column)))
        pq.write_table(table, folder / name)
    return str(folder)


@pytest.fixture
def no_broadcasts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        if k in before:
            spark.conf.set(k, before[k])
        else:
            spark.conf.unset(k)


@pytest.mark.parametrize("name", KINDS)
def test_hot_keys_without_broadcasts_equal_sql(spark, hot, no_broadcasts, name):
    got, con = QUERIES[name](spark, hot), connect(hot)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the table of partition offsets alone may be broadcast: it has a row per shuffle partition
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [_slice")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(got.toArrow(), con.execute(ORACLE[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name,facts", [("stock_flow_sum", "lineitem"), ("stock_month_end", "lineitem"), ("demand_by_product_month", "orders")])
def test_facts_shrink_to_sites_and_months_before_they_move(spark, hot, no_broadcasts, name, facts):
    """No raw row of a hot site is shuffled to find its branch: what the fact's scan hands on is
    looked up in the parts at most, and aggregated by site and month before the join with the sites."""
    plan = QUERIES[name](spark, hot)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(plan) if "FileScan" in x and f"{facts}.parquet" in x)
    above = [x for x in plan[:scan] if re.search(r"Exchange hashpartitioning|partial_|SortMergeJoin", x)]
    sites = [i for i, x in enumerate(plan) if "SortMergeJoin [site" in x]
    partial = [i for i, x in enumerate(plan[:scan]) if "partial_" in x]
    assert above and sites and partial and max(partial) > sites[-1]
