"""Row cleaning: case-insensitive dedup (W1/J3), target filters (P5–P7), validity split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.operators.rowid import free_name, with_scan_number


def dedup_lower(df: DataFrame, col: str, row_id: str | None = "row_id", hash_key: bool = True) -> tuple[DataFrame, DataFrame]:
    """W1 + J3: keep the first row of each lower-cased ``col``: the one of the smallest ``row_id``
    (nulls first), of equal ones the first in scan order; without a ``row_id`` column, the
    first in scan order.

    Returns (kept, dropped).  Rows are told apart by a scan-order number of their own, so an
    id may repeat.  Skew-safe: the per-key minimum is a partial (map-side
    combined) aggregate, so a key holding a third of the table collapses to one row
    per map task; the rows are then matched on the unique number — evenly hashed —
    instead of being windowed per key.  NULL keys form one group.  ``hash_key`` groups on
    SHA-256 of the lower-cased key (a collision between different keys is practically
    impossible); ``hash_key=False`` groups on the key itself.
    """
    # group on a 32-byte digest of the lower-cased key, not on the key itself: long
    # texts are never shuffled as grouping keys (NULL keys still form one group)
    key = F.sha2(F.lower(F.col(col).cast("string")), 256) if hash_key else F.lower(F.col(col))
    number = free_name(df, "_number")
    own = with_scan_number(df, number)
    order = [F.col(row_id)] if row_id and row_id in df.columns else []
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(number).alias("n")))
    firsts = own.groupBy(key.alias("_k")).agg(first.alias("f")).select(F.col("f.n").alias(number))
    kept = own.join(firsts, number, "left_semi").select(*df.columns)
    dropped = own.join(firsts, number, "left_anti").select(*df.columns)
    return kept, dropped


def dedup_summary(df: DataFrame, col: str) -> DataFrame:
    """Counts: rows, distinct lower-cased keys, duplicates dropped (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  (F.count_distinct(F.sha2(F.lower(F.col(col).cast("string")), 256))
                   + F.max(F.col(col).isNull().cast("int"))).alias("n_kept")) \
        .withColumn("n_dropped", F.col("n_rows") - F.col("n_kept"))


def range_filter(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Inclusive range on ``col``; an unset bound is open (equivalent to the
    reference's min/max default without an extra pass).  0 is a real bound."""
    # plain comparisons on the raw column reach the parquet scan as pushed filters;
    # NaN (which Spark orders above every number) is excluded explicitly
    c = F.col(col) if dict(df.dtypes).get(col) == "double" else F.col(col).cast("double")
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= float(lo))
    if hi is not None:
        cond = cond & (c <= float(hi))
    cond = cond & ~F.isnan(c)
    if col not in df.columns:
        raise ValueError(f"{col} not in the DataFrame")
    return df.where(cond)


def drop_null_target(df: DataFrame, col: str) -> DataFrame:
    """P5."""
    return df.where(F.col(col).isNotNull())


def drop_zero_vectors(df: DataFrame, vec: str, mode: str = "any") -> DataFrame:
    """Drop a row when any (default, as the reference) or all components are 0."""
    v = F.col(vec)
    if mode == "any":
        return df.where(F.col(vec).isNotNull() & ~F.exists(v, lambda z: z == 0))
    return df.where(F.col(vec).isNotNull() & ~F.forall(v, lambda z: z == 0))


def split_valid(df: DataFrame, flag: str = "is_valid") -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows) from one boolean column."""
    return df.where(F.col(flag)), df.where(~F.col(flag) | F.col(flag).isNull())


def validity_counts(df: DataFrame, flag: str = "is_valid") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(flag)).alias("n_valid"),
                  F.count_if(~F.coalesce(F.col(flag), F.lit(False))).alias("n_invalid"))
