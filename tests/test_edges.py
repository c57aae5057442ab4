"""FIXTURES part C numeric edge frames through every distribution operator."""

import pytest

from propkit.operators import stats as S
from propkit.operators.power import auto_transform
from propkit.operators.scalers import SCALERS, fit_scaler

FRAMES = {
    "nan_null_zero_neg": [(float("nan"),), (None,), (0.0,), (-2.0,), (5.0,), (1.0,)],
    "one_row": [(3.0,)],
    "constant": [(2.0,)] * 5,
    "ties": [(1.0,), (1.0,), (2.0,), (2.0,), (2.0,), (9.0,)],
}
OPS = ["describe", "histogram", "kde", "qq_points", "anderson_darling", "skew_kurtosis"]


@pytest.mark.parametrize("name", list(FRAMES))
def test_distribution_ops_do_not_fail(spark, name):
    df = spark.createDataFrame(FRAMES[name], "v double")
    n = len([r for r in FRAMES[name] if r[0] is not None and r[0] == r[0]])
    for op in OPS:
        getattr(S, op)(df, "v").collect()
    assert S.describe(df, "v").first()["count"] == n
    assert sum(r["count"] for r in S.histogram(df, "v").collect()) == n
    # power-transform fits run a λ search: exercised on the two frames where they matter
    scalers = SCALERS if name in ("nan_null_zero_neg", "constant") else SCALERS[:5]
    for m in scalers:
        f = fit_scaler(df, "v", m)
        df.select(f.transform("v")).collect()
    if name in ("nan_null_zero_neg", "ties"):
        assert auto_transform(df, "v").best is not None


def test_constant_has_no_ad_statistic(spark):
    df = spark.createDataFrame(FRAMES["constant"], "v double")
    assert all(r["statistic"] is None for r in S.anderson_darling(df, "v").collect())
    assert auto_transform(df, "v").best == "original"


def test_clear_errors(spark):
    huge = spark.createDataFrame([(1e308,), (-1e308,), (0.0,)], "v double")
    with pytest.raises(ValueError, match="not finite"):
        S.histogram(huge, "v")
    empty = spark.createDataFrame([], "v double")
    assert S.anderson_darling(empty, "v").count() == 0
    for m in SCALERS[:5]:
        with pytest.raises(ValueError, match="no non-null values"):
            fit_scaler(empty, "v", m)


def test_constant_column_report_and_repeated_ids(spark):
    from propkit.plans import jobs
    r = jobs.distribution_report(spark.createDataFrame(FRAMES["constant"], "v double"), "v")
    assert r["anderson_darling_test"]["statistic"] is None
    kept, dropped = jobs.dedup_job(spark.createDataFrame([(1, "a"), (1, "A"), (2, "b")], "row_id long, s string"), "s")
    assert kept.count() == 2 and dropped.count() == 1
