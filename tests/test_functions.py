import math
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from propkit.functions.normal import cdf_stages, log_cdf_stages, ppf_stages
from propkit.functions.parse import clean_text, parse_number_or_range
from propkit.functions.staged import apply_stages, stages_sql


def test_normal_cdf_and_logs_match_erfc():
    xs = [-30, -20, -8, -4.2, -1, -0.3, 0, 0.2, 0.47, 1.3, 3.9, 4.1, 7, 12]
    vals = ",".join(f"({x}::DOUBLE)" for x in xs)
    st = cdf_stages("x", "c") + log_cdf_stages("x", "lc", "ls")
    rows = duckdb.sql(stages_sql(f"SELECT * FROM (VALUES {vals}) t(x)", st, "x, c, lc, ls")).fetchall()
    for x, c, lc, ls in rows:
        ref = 0.5 * math.erfc(-x / math.sqrt(2))
        assert c == pytest.approx(ref, rel=1e-13, abs=1e-300)
        if ref > 0:
            assert lc == pytest.approx(math.log(ref), rel=1e-12)
        sf = 0.5 * math.erfc(x / math.sqrt(2))
        if sf > 0:
            assert ls == pytest.approx(math.log(sf), rel=1e-12)
    # deep tail is finite in log space
    assert rows[0][2] < -400


def test_normal_ppf_matches_statistics(spark):
    ps = [1e-12, 1e-5, 0.01, 0.0242, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    out = apply_stages(df, ppf_stages("p", "z"), keep=["z"]).collect()
    nd = statistics.NormalDist()
    for r in out:
        assert r["z"] == pytest.approx(nd.inv_cdf(r["p"]), rel=1e-12, abs=1e-12)
    assert apply_stages(spark.createDataFrame([(0.0,), (1.0,)], "p double"), ppf_stages("p", "z")).where(
        F.col("z").isNotNull()).count() == 0


def test_range_strings(spark):
    # FIXTURES part C: range strings
    raw = ["5", " 188.0 ", "188.0 - 189.0", "-5", "-5 - 3", "1e-3", "5d", "abc", "", None, "nan"]
    want = [5.0, 188.0, 188.5, -5.0, None, 0.001, None, None, None, None, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "i int, s string")
    got = [r["y"] for r in df.select("i", parse_number_or_range("s").alias("y")).orderBy("i").collect()]
    assert got == want


def test_clean_text(spark):
    df = spark.createDataFrame([("C\u00a0CO ",), ("nan",), (None,)], "s string")
    assert [r[0] for r in df.select(clean_text("s")).collect()] == ["CCO", None, None]
