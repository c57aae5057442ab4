import math
import statistics

import numpy as np
import pytest

from propkit.operators import stats as S
from tests.conftest import SF


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture(scope="module")
def x(events):
    return np.array([r[0] for r in events.select("value").collect() if r[0] is not None])


def test_describe_matches_numpy(events, x):
    d = S.describe(events, "value").first()
    assert d["count"] == len(x)
    assert d["std"] == pytest.approx(x.std(ddof=1))
    for q, p in (("q25", 25), ("q50", 50), ("q75", 75)):
        assert d[q] == pytest.approx(np.percentile(x, p))


def test_histogram_auto_matches_numpy(events, x):
    h = S.histogram(events, "value").orderBy("bin").collect()
    counts, edges = np.histogram(x, bins="auto")
    assert [r["count"] for r in h] == counts.tolist()
    assert np.allclose([r["lo"] for r in h] + [h[-1]["hi"]], edges)


def test_histogram_constant_and_single(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    h = S.histogram(df, "v").collect()
    assert len(h) == 1 and h[0]["lo"] == 2.5 and h[0]["hi"] == 3.5 and h[0]["count"] == 4
    one = S.histogram(spark.createDataFrame([(7.0,)], "v double"), "v").collect()
    assert [r["count"] for r in one] == [1]


def test_anderson_darling_matches_formula(events, x):
    a = S.anderson_darling(events, "value").collect()
    n = len(x)
    w = (np.sort(x) - x.mean()) / x.std(ddof=1)
    lc = np.array([math.log(0.5 * math.erfc(-t / math.sqrt(2))) for t in w])
    ls = np.array([math.log(0.5 * math.erfc(t / math.sqrt(2))) for t in w])
    i = np.arange(1, n + 1)
    a2 = -n - np.sum((2 * i - 1.0) / n * (lc + ls[::-1]))
    assert a[0]["statistic"] == pytest.approx(a2, rel=1e-9)
    assert [r["critical_value"] for r in a] == [round(v / (1 + 4 / n - 25 / n / n), 3)
                                                 for v in (0.576, 0.656, 0.787, 0.918, 1.092)]


def test_qq_points(events, x):
    q = S.qq_points(events, "value").orderBy("rank").collect()
    n = len(x)
    v = np.empty(n)
    v[-1] = 0.5 ** (1 / n)
    v[0] = 1 - v[-1]
    v[1:-1] = (np.arange(2, n) - 0.3175) / (n + 0.365)
    nd = statistics.NormalDist()
    assert max(abs(r["theoretical_quantile"] - nd.inv_cdf(p)) for r, p in zip(q, v)) < 1e-12
    assert [r["sample_quantile"] for r in q] == sorted(x.tolist())


def test_kde_and_skew(events, x):
    k = S.kde(events, "value").orderBy("point").collect()
    grid = np.linspace(x.min(), x.max(), 100)
    h = x.std(ddof=1) * len(x) ** -0.2
    ref = np.exp(-(grid[:, None] - x[None, :]) ** 2 / (2 * h * h)).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in k], ref, rtol=1e-10)
    s = S.skew_kurtosis(events, "value").first()
    n = len(x)
    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
    g1 = m3 / m2 ** 1.5
    assert s["skew_biased"] == pytest.approx(g1)
    assert s["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
