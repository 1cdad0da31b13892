"""Plan checks: no Cartesian products, no row-at-a-time Python, pruned scans."""

import re

import pytest

from lotwise import plans as E

SF = "/root/testdata/sf0.001"
BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
PYTHON_ALLOWED = {"model_normal_equations", "retrained_normal_equations", "model_level_sums", "product_models", "product_model_r2", "forecast_demand", "forecast_manifest"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for b in BAD:
        assert b not in plan, f"{name}: {b}"
    if name not in PYTHON_ALLOWED:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan, name


def test_lineitem_scan_is_pruned(spark):
    plan = _plan(E.queries()["lot_consumption"](spark, SF))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    li = [s for s in scans if "l_partkey" in s]
    assert li, plan
    cols = {c.split("#")[0] for c in li[0].split(",")}
    assert cols == {"l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"}


def test_window_filter_reaches_orders_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # show the filters in full
    df = E.queries()["product_consumption_30d"](spark, SF)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    assert any("GreaterThanOrEqual(o_orderdate,2001-07-02" in p for p in pushed), pushed


def test_fact_aggregated_before_lot_join(spark):
    df = E.queries()["lot_inventory"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    agg = plan.find("Aggregate [lot_id")
    assert agg >= 0
