import numpy as np
import pytest

from propkit.functions import transforms as TR
from propkit.operators.power import auto_transform, boxcox_lambda, yeo_johnson_lambda
from propkit.operators.scalers import SCALERS, fit_scaler
from tests.conftest import SF


def _bc_llf(x, lam):
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_boxcox_lambda_is_mle(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    x = np.array([r[0] for r in e.select("value").collect()])
    lam = boxcox_lambda(e, "value")
    grid = np.linspace(lam - 0.01, lam + 0.01, 201)
    assert abs(grid[np.argmax([_bc_llf(x, g) for g in grid])] - lam) <= 1e-4


def test_yeo_johnson_handles_negatives(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    lam = yeo_johnson_lambda(c, "c_acctbal")
    assert -3 < lam < 4
    back = c.select("c_acctbal", TR.yeo_johnson_inverse(TR.yeo_johnson("c_acctbal", lam), lam).alias("b")).collect()
    assert max(abs(r[0] - r[1]) for r in back) < 1e-6


@pytest.mark.parametrize("method", ["log1p", "sqrt", "reciprocal", "square", "exp"])
def test_simple_inverse_roundtrip(spark, method):
    df = spark.createDataFrame([(0.5,), (3.0,), (10.0,)], "v double")
    out = df.select("v", TR.inverse(TR.forward("v", method), method).alias("b")).collect()
    assert all(abs(r[0] - r[1]) < 1e-9 for r in out)


def test_reciprocal_div_zero_is_null(spark):
    df = spark.createDataFrame([(-1.0,)], "v double")
    assert df.select(TR.forward("v", "reciprocal")).first()[0] is None


@pytest.mark.parametrize("method", SCALERS)
def test_scaler_roundtrip(spark, method):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_acctbal")
    fit = fit_scaler(c, "c_acctbal", method)
    out = c.select("c_acctbal", fit.inverse(fit.transform("c_acctbal")).alias("b")).collect()
    assert max(abs(r[0] - r[1]) for r in out) < 1e-5


def test_constant_column_scalers(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert fit_scaler(df, "v", "MinMaxScaler").params["scale"] == 1.0
    assert df.select(fit_scaler(df, "v", "StandardScaler").transform("v")).first()[0] == 0.0


def test_auto_transform_picks_min_abs_skew(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    ch = auto_transform(e, "value")
    assert ch.skew_before > 0
    assert set(ch.scores) == {"original", "log1p", "sqrt", "reciprocal", "boxcox", "yeo_johnson"}
    finite = {m: s for m, s in ch.scores.items() if s is not None}
    assert ch.best == min(finite, key=lambda m: abs(finite[m]))


def test_lambda_far_outside_the_first_bracket(spark):
    u = [(((i + 0.5) / 400) ** (1 / 400),) for i in range(400)]
    lam = boxcox_lambda(spark.createDataFrame(u, "v double"), "v")
    assert 270 < lam < 296


def _yj(x, lam):
    pos = np.log1p(np.abs(x)) if lam == 0 else ((np.abs(x) + 1) ** lam - 1) / lam
    neg = -np.log1p(np.abs(x)) if lam == 2 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, pos, neg)


def _peak(llf, lo, hi):
    """The maximum by dense grids, one inside the other."""
    while hi - lo > 1e-9:
        g = np.linspace(lo, hi, 41)
        k = int(np.argmax([llf(v) for v in g]))
        lo, hi = g[max(k - 1, 0)], g[min(k + 1, 40)]
    return (lo + hi) / 2


@pytest.mark.parametrize("kind", ["lognormal", "gamma", "normal", "left", "logarithm", "tiny"])
def test_newton_finds_the_maximum(spark, kind):
    rng = np.random.default_rng(7)
    x = {"lognormal": rng.lognormal(0, 1, 3000), "gamma": rng.gamma(2, 3, 3000) + 0.01, "normal": rng.normal(50, 3, 3000), "left": 10 - rng.gamma(2, 1, 3000),
         "logarithm": np.exp(rng.normal(0, 1e-3, 3000)), "tiny": rng.lognormal(0, 1, 3000) * 1e-8}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    yj = yeo_johnson_lambda(df, "v")
    llf = lambda lm: (lm - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum() - len(x) / 2 * np.log(_yj(x, lm).var())
    if kind != "tiny":  # so flat there that a grid cannot tell
        near = _peak(llf, yj - 1, yj + 1)
        assert abs(yj - near) < 1e-4 * max(1, abs(near)) and llf(yj) >= llf(near) - 1e-7
    if x.min() > 0:
        bc = boxcox_lambda(df, "v")
        assert _bc_llf(x, bc) >= max(_bc_llf(x, g) for g in np.linspace(bc - 1, bc + 1, 401)) - 1e-7


def test_no_likelihood_is_told_apart(spark):
    same = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert boxcox_lambda(same, "v") == yeo_johnson_lambda(same, "v") == 1.0
    huge = spark.createDataFrame([(1e308,), (-1e308,), (0.0,)], "v double")
    with pytest.raises(ValueError):
        yeo_johnson_lambda(huge, "v")
    with pytest.raises(ValueError):
        boxcox_lambda(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), "v")


def test_boxcox_fit_with_values_outside_its_domain(spark, tmp_path):
    from propkit.plans.queries import q_boxcox_fit
    vals = [0.5, 1.0, 2.5, 4.0, 7.5, 20.0, 55.0]
    rows = [(i, v) for i, v in enumerate([*vals, 0.0, -3.0, None])]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = q_boxcox_fit(spark, str(tmp_path)).first()
    x = np.array(vals)
    grid = np.linspace(got["lam"] - 0.01, got["lam"] + 0.01, 201)
    assert abs(grid[np.argmax([_bc_llf(x, g) for g in grid])] - got["lam"]) <= 1e-4
    y = np.array([*vals, 0.0] if got["lam"] > 0 else vals)
    y = (y ** got["lam"] - 1) / got["lam"]
    assert abs(((y - y.mean()) ** 3).mean() / y.std() ** 3 - got["skew"]) < 1e-4
    assert got["n"] == 10
