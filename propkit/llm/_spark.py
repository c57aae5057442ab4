"""Spark helpers shared by the operators: lineage cuts, hot-group-safe running sums, components."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propkit.session import Table, cut_lineage  # noqa: F401 (Table for the operators)

WS = r"\x20\x09-\x0D"  # word separators; everything else is a word character
WORD = f"[^{WS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: later passes read
    the same rows, no matter which tasks run again."""
    return cut_lineage(df)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are written and done with.  It does so once the
    driver has collected what refers to them, which may come too late for the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def parted(df: DataFrame, col: str) -> DataFrame:
    """``df`` without the planner's knowledge that it lies by ``col``: a join then reads both sides from
    an exchange of its own, and a hot key can be split where it is read."""
    return df.withColumn(col, F.col(col).bitwiseXOR(F.lit(0).cast("long")))


def tmp(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (compared as Spark does, without case)."""
    have = {c.lower() for c in df.columns}
    out = f"_pk_{name}"
    while out.lower() in have:
        out += "_"
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only (for plain ASCII text that is what ``lower`` does, faster)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def hash_key(*cols: Column) -> Column:
    """60 evenly spread bits of the row as a non-negative long (from md5, so SQL has it too)."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_sums(df: DataFrame, groups: list[str], key: Column, ties: list[str], sums: dict[str, Column],
                 rows: int, bucket: Column | None = None) -> DataFrame:
    """Exclusive running sums within groups, without a task per group.

    The order is ``(bucket, key, ties)``.  ``key`` is a non-negative, evenly spread hash of
    the row; ``bucket`` may replace the hash bucket by a coarse range of an ordered key.  Rows are dealt to about
    ``sqrt(rows)`` buckets per group; the bucket totals are few (``groups x sqrt(rows)``)
    and are summed first, then each (group, bucket) is summed for itself.  A group with a
    third of all rows is therefore spread over all tasks.  ``df`` must give the same rows
    when read again (a scan or a stored frame).
    """
    buckets = max(1, math.isqrt(max(rows, 1)))
    b, k = tmp(df, "bucket"), tmp(df, "key")
    x = df.withColumn(k, key).withColumn(
        b, F.pmod(F.col(k), F.lit(buckets)) if bucket is None else bucket)
    names = {n: f"{b}_{i}" for i, n in enumerate(sums)}
    totals = x.groupBy(*groups, b).agg(*[F.sum(c).alias(names[n]) for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, b, *[F.coalesce(F.sum(names[n]).over(before), F.lit(0)).alias(names[n]) for n in sums])
    for i, g in enumerate([*groups, b]):
        offsets = offsets.withColumnRenamed(g, f"{k}_{i}")
    on = [x[g].eqNullSafe(offsets[f"{k}_{i}"]) for i, g in enumerate([*groups, b])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    within = Window.partitionBy(*groups, b).orderBy(k, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = x.join(offsets, cond)
    for n, c in sums.items():
        out = out.withColumn(n, (F.col(names[n]) + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long"))
    return out.select(*df.columns, *sums)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for every node that has an edge; ``root`` is the smallest node
    of its component.  Each round is two shuffles of the links and is stored, so it needs
    neither the driver nor one task per component.  A star's hub row is aggregated
    before it is joined, and the join may be split where a hub is hot.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        nxt = stored(small.where("u <> v").distinct())
        # finished when every node hangs on one root that hangs on nothing
        ends = nxt.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            nxt.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        e = nxt
        if not ends.where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
