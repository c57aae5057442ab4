from pyspark.sql import functions as F

from propkit.operators.clean import dedup_lower, drop_zero_vectors, range_filter
from propkit.operators.rowid import global_rank, with_row_index
from tests.conftest import SF


def test_dedup_nulls_group_and_keep_first(spark):
    df = spark.createDataFrame([(0, "A"), (1, "a"), (2, "b"), (3, None), (4, None)], "row_id long, s string")
    kept, dropped = dedup_lower(df, "s")
    assert sorted(r[0] for r in kept.collect()) == [0, 2, 3]
    assert sorted(r[0] for r in dropped.collect()) == [1, 4]


def test_dedup_plan_has_no_window(spark):
    df = spark.read.parquet(f"{SF}/part.parquet").withColumnRenamed("p_partkey", "row_id")
    kept, _ = dedup_lower(df, "p_name")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_range_filter_zero_bound_and_unset(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert range_filter(df, "v", lo=0.0).count() == 2
    assert range_filter(df, "v", hi=0.0).count() == 2
    assert range_filter(df, "v").count() == 3
    assert range_filter(df, "v", 5.0, 1.0).count() == 0


def test_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0, 2.0],)], "v array<double>")
    assert drop_zero_vectors(df, "v").count() == 1
    assert drop_zero_vectors(df, "v", mode="all").count() == 2


def test_row_index_dense_ordered(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    idx = with_row_index(o, "rid", order_by=["o_totalprice", "o_orderkey"], num_partitions=4).collect()
    assert sorted(r["rid"] for r in idx) == list(range(len(idx)))
    by = sorted(idx, key=lambda r: r["rid"])
    assert [(r["o_totalprice"], r["o_orderkey"]) for r in by] == sorted((r["o_totalprice"], r["o_orderkey"]) for r in idx)
    scan = with_row_index(o, "rid").collect()
    assert sorted(r["rid"] for r in scan) == list(range(len(scan)))


def test_global_rank_no_single_partition_window(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    r = global_rank(e, "value", num_partitions=4)
    assert r.select("rank", F.spark_partition_id().alias("p")).distinct().groupBy().agg(F.count_distinct("p")).first()[0] == 4
    vals = [x["value"] for x in r.orderBy("rank").collect()]
    assert vals == sorted(vals)
    assert r.agg(F.max("rank")).first()[0] == r.count()


def test_row_index_with_payload_does_not_need_exchange_reuse(spark):
    o = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = with_row_index(o, "rid", order_by=["o_custkey"]).select("rid", "o_custkey").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert sorted(r["rid"] for r in rows) == list(range(o.count()))
    keys = [r["o_custkey"] for r in sorted(rows, key=lambda r: r["rid"])]
    assert keys == sorted(keys)


def test_dedup_with_repeated_ids_and_taken_names(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "A", 1), (2, "b", 2), (7, None, 3), (7, None, 4)], "row_id long, _number string, k int")
    kept, dropped = dedup_lower(df, "_number")
    assert kept.columns == df.columns
    assert sorted(r.k for r in kept.collect()) == [0, 2, 3] and sorted(r.k for r in dropped.collect()) == [1, 4]
    late = spark.createDataFrame([(5, "x", 0), (3, "X", 1)], "row_id long, s string, k int")
    assert [r.k for r in dedup_lower(late, "s")[0].collect()] == [1]
    assert [r.k for r in dedup_lower(late, "s", None)[0].collect()] == [0]


def test_dedup_job_with_a_first_column(spark):
    from propkit.plans import jobs
    df = spark.createDataFrame([(7, "a", 1), (7, "A", 1), (7, "b", 1)], "row_id long, s string, _first int")
    kept, dropped = jobs.dedup_job(df, "s")
    assert kept.columns == df.columns and sorted(r.s for r in kept.collect()) == ["a", "b"] and [r.s for r in dropped.collect()] == ["A"]
    kept, _ = jobs.dedup_job(df.drop("row_id"), "s")
    assert sorted(r.row_id for r in kept.collect()) == [0, 2]
