"""Distributed row index and global rank.

No un-partitioned window over the data.  An ordered index lays the rows out once: they are
range-partitioned and sorted on the order key and a scan-order tie-break, and that layout is
written to the shared checkpoint folder.  Each stored partition is numbered locally with
``monotonically_increasing_id`` (local position in the low 33 bits), and a per-partition
offset (one aggregate of ``#partitions`` rows) is added.  Counts and rows are read from the
same stored files, so they cannot disagree, whatever Spark samples, reuses or runs again.
A scan-order index numbers a file scan directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propkit.session import cut_lineage

_LOW33 = (1 << 33) - 1


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (compared as Spark does, without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _number_partitions(df: DataFrame, name: str, start: int) -> DataFrame:
    local = df.withColumn("_pk_pid", F.spark_partition_id()).withColumn(
        "_pk_mid", F.monotonically_increasing_id())
    counts = local.groupBy("_pk_pid").agg(F.count(F.lit(1)).alias("_pk_n"))
    # offsets over #partitions rows only (bounded by the partition count, not by data)
    w = Window.orderBy("_pk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pk_pid", F.coalesce(F.sum("_pk_n").over(w), F.lit(0)).alias("_pk_off"))
    out = local.join(F.broadcast(offsets), "_pk_pid")
    rid = F.col("_pk_off") + F.expr(f"_pk_mid & {_LOW33}") + F.lit(start)
    return out.withColumn(name, rid.cast("long")).drop("_pk_pid", "_pk_mid", "_pk_off")


_ORDERED_NODES = {"Project", "Filter", "LocalRelation", "Range"}


def _repeats(node) -> bool:
    """Does reading this plan again give the same rows in the same order?  File scans,
    checkpointed frames and deterministic row-wise steps on them do."""
    kind = node.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return node.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if kind == "LogicalRDD":
        return node.rdd().isCheckpointed()
    children = node.children()
    return kind in _ORDERED_NODES and all(_repeats(children.apply(i)) for i in range(children.size()))


def _stable(df: DataFrame) -> DataFrame:
    """Numbering relies on re-executed tasks seeing the same rows in the same order.  What
    does not promise that is first written to the shared checkpoint folder
    (``spark.checkpoint.dir``) and numbered from there."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and _repeats(plan) else cut_lineage(df)


def with_scan_number(df: DataFrame, name: str) -> DataFrame:
    """A unique number in scan order, with gaps: no pass over the data, the same whenever the
    frame is read again."""
    return _stable(df).withColumn(name, F.monotonically_increasing_id())


ROWS_PER_PARTITION = 500_000


def _range_partitions(df: DataFrame) -> int:
    """Range partitions for numbering: ``ROWS_PER_PARTITION`` rows each, and at least the
    default parallelism; the number grows with the rows without a cap."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_PARTITION))


def with_row_index(df: DataFrame, name: str = "row_id", order_by: list[str | Column] | None = None,
                   num_partitions: int | None = None, start: int = 0) -> DataFrame:
    """Attach a dense 0-based (or ``start``-based) row index.

    * ``name`` already a column → returned unchanged (the reference then uses it as
      the index).
    * ``order_by`` None → scan order (no shuffle at all).
    * otherwise → global order of ``order_by`` (ascending, nulls first) with a
      scan-order tie-break; one range shuffle, stored.
    """
    if name in df.columns:
        return df
    df = _stable(df)
    if not order_by:
        return _number_partitions(df, name, start)
    n = num_partitions or _range_partitions(df)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    tied = df.withColumn("_pk_tie", F.monotonically_increasing_id())
    ordered = (tied.repartitionByRange(n, *keys, F.col("_pk_tie"))
               .sortWithinPartitions(*keys, F.col("_pk_tie")))
    return _number_partitions(cut_lineage(ordered), name, start).drop("_pk_tie")


def global_rank(df: DataFrame, col: str, name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each non-null value of ``col`` in ascending order."""
    vals = df.select(F.col(col)).where(F.col(col).isNotNull())
    return with_row_index(vals, name=name, order_by=[col], num_partitions=num_partitions, start=1)
