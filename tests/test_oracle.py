"""Registered queries against their DuckDB twins on sf0.001 (a fast subset of the driver's gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF
from tools.check_oracle import TABLES, digest

FAST = ["row_count", "preview_head", "preview_tail", "row_index", "dedup_kept", "dedup_dropped", "range_filter",
        "parse_range_target", "training_rows", "describe", "histogram", "skew_kurtosis", "kde", "qq_plot",
        "anderson_darling", "transform_candidates", "scalar_transforms", "scale_robust", "structure_profile",
        "size_bins", "top_elements", "profile_filter", "prediction_metrics", "train_test_split",
        "vector_standardize", "corpus_structures"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(res.columns)
    assert digest([tuple(r) for r in sdf.collect()], sdf.columns)[0] == digest(res.fetchall(), res.columns)[0]


def test_every_query_registered_with_oracle_or_listed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
