"""Plan checks: no cartesian products, Python only in the corpus scan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tunewright.plans import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
# queries whose input is the syntax scan of code cells (checkpointed, so their plans read
# the scan's output, not the Python step), and the ML queries (driver loops of fits)
ML = {"search_lr", "search_trials", "search_logistic", "select_from_model", "rfe", "submission", "raw_vs_prepared",
      "sweep_run", "sweep_multi"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ML))
def test_plan_has_no_cartesian_and_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for node in PYTHON_NODES:
        assert node not in plan, f"{name}: {node} in plan"


def test_scans_prune_columns_and_push_filters(spark):
    df = QUERIES["drop_rows"](spark, SF)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
