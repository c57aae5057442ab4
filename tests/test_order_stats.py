"""Selection and ranks against NumPy on skewed, tied and extreme columns."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from propkit.operators import order_stats as O
from propkit.operators import stats
from propkit.operators.model import split_train_test


def frame(spark, x):
    return spark.createDataFrame([(float(v),) for v in x], "y double").repartition(3)


@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_sortable_keeps_the_order(x):
    x = np.array(x) + 0.0
    u = O.sortable(x)
    assert (O.original(u, True) == x).all()
    assert (np.argsort(u, kind="stable") == np.argsort(x, kind="stable")).all()


COLUMNS = {
    "tied": [3.0] * 500, "two": [1.0, 2.0] * 100, "one": [7.0], "signs": [-0.0, 0.0, -1.5, 1e-300, -1e-300, 5e-324],
    "wide": [10.0 ** k for k in range(-300, 300, 3)] + [-(10.0 ** k) for k in range(-300, 300, 7)],
    "close": [1.0 + k * 2.0 ** -52 for k in range(300)], "hot": [5.0] * 700 + list(np.random.default_rng(1).normal(5, 1e-9, 300)),
    "infinite": [float("inf"), float("-inf"), 0.0, 1.0],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_order_statistics(spark, monkeypatch, name):
    x = np.sort(np.array(COLUMNS[name]) + 0.0)
    ranks = sorted({0, len(x) // 3, len(x) // 2, len(x) - 1})
    for rows in (1 << 17, 0):  # read the last rows, or go down to the last bit
        monkeypatch.setattr(O, "COLLECT_ROWS", rows)
        got = O.order_statistics(frame(spark, COLUMNS[name]), [*ranks, len(x) + 5])
        assert got == {r: (x[r], int(np.searchsorted(x, x[r]))) for r in ranks}


@pytest.mark.parametrize("name", COLUMNS)
def test_ranks(spark, monkeypatch, name):
    x = np.sort(np.array(COLUMNS[name]) + 0.0)
    got = O.distinct_ranks(frame(spark, COLUMNS[name]), len(x)).collect()
    v, first, n = np.unique(x, return_index=True, return_counts=True)
    assert sorted((r.y, r["first"], r.n) for r in got) == list(zip(v.tolist(), (first + 1).tolist(), n.tolist()))
    rows = O.expanded(O.distinct_ranks(frame(spark, COLUMNS[name]), len(x)), chunk=64).collect()
    assert sorted((r["rank"], r.y) for r in rows) == list(zip(range(1, len(x) + 1), x.tolist()))


def test_many_quantiles(spark):
    x = np.random.default_rng(3).lognormal(0, 3, 20000)
    probs = np.linspace(0, 1, 501).tolist()
    got = O.quantiles(frame(spark, x), len(x), probs)
    assert np.allclose(got, np.quantile(x, probs), rtol=1e-12)
    assert O.quantiles(frame(spark, []), 0, [0.5]) == [None]


def test_no_sort_of_rows(spark):
    df = frame(spark, range(100))
    plan = stats.qq_points(df, "y")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=2, max_size=60), st.floats(0.05, 0.9))
def test_split_is_exact(spark, ids, share):
    import hashlib
    import math
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "row_id long, k long")
    got = {r.k: r.split for r in split_train_test(df, share, 5).collect()}
    order = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), i) for i in ids)
    cut = order[math.ceil(share * len(ids)) - 1]
    assert got == {k: "test" if (hashlib.md5(f"5:{i}".encode()).hexdigest(), i) <= cut or math.ceil(share * len(ids)) >= len(ids) else "train" for k, i in enumerate(ids)}
