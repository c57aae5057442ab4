"""Plan checks: no cross products anywhere, filters pushed into the scan, no data windows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF

CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_cross_product(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not any(c in plan for c in CROSS), plan


def test_range_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["range_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,10.0), LessThanOrEqual(value,100.0)" in plan


def test_projection_pruned_at_scan(spark):
    plan = _plan(E.queries()["range_filter"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_dedup_and_filter_have_no_window(spark):
    for name in ("dedup_kept", "dedup_documents", "profile_filter", "knn_predict"):
        plan = _plan(E.queries()[name](spark, SF))
        assert "RowNumber" not in plan or name == "knn_predict", name
    # the knn top-k window is keyed by query id (k × #blocks rows per key), never un-keyed
    knn = _plan(E.queries()["knn_predict"](spark, SF))
    assert "Window [row_number()" in knn and "[qid" in knn
