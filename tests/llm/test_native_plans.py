"""The native operators run without Python workers; no operator's plan has a cross join."""

import pytest

from lotwise.llm import queries as Q

SF = "/root/testdata/sf0.001"
PYTHON = ["ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsIn", "FlatMapCoGroupsIn", "PythonUDF"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op7_mix_sources", "op10_license_scan"])
def test_native(spark, name):
    plan = _plan(Q.queries()[name](spark, SF))
    assert not [p for p in PYTHON if p in plan]


@pytest.mark.parametrize("name", ["op7_mix_sources", "op9_byte_bpe", "op10_license_scan", "op11_collocations", "op12_lm_score", "op13_filter_audit"])
def test_no_cross_join(spark, name):
    plan = _plan(Q.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
