"""Order statistics and ranks of one column without sorting its rows.

Values become 64-bit numbers that sort as they do.  *Selection* counts the rows by the
leading bits (at most ``1 << ROOT_BITS`` counters a task, added up before anything is
shuffled), keeps only the classes that hold a wanted rank, and counts those by their next
bits; as soon as few rows are left they are read.  At most 64 bits can be passed, so it ends
for any distribution, and the driver sees a bounded number of counters.

*Ranks* group equal values first.  The same counts cut the value range into buckets of about
equal size, so a bucket's distinct values are ranked by one running sum and the rows below
the bucket are known beforehand: no sampling, no range exchange of the rows, no stored
layout, and a value that a third of the rows share is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROOT_BITS, COLLECT_ROWS, BUCKET_ROWS = 18, 1 << 17, 500_000
_SIGN = np.uint64(1 << 63)


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles or longs as unsigned numbers in the same order (-0.0 equals 0.0)."""
    if x.dtype.kind == "f":
        b = (x.astype(np.float64) + 0.0).view(np.int64)
        x = b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return x.astype(np.int64).view(np.uint64) ^ _SIGN


def original(u: np.ndarray, floating: bool) -> np.ndarray:
    b = (u ^ _SIGN).view(np.int64)
    return (b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64) if floating else b


def _shift(u: np.ndarray, by: int) -> np.ndarray:
    return u >> np.uint64(by) if by < 64 else np.zeros_like(u)


def _inside(u: np.ndarray, prefixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose first ``depth`` bits are one of the sorted ``prefixes``, and which."""
    p = _shift(u, 64 - depth)
    at = np.minimum(np.searchsorted(prefixes, p), len(prefixes) - 1)
    hit = prefixes[at] == p
    return u[hit], at[hit]


def _counter(prefixes: np.ndarray, depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(prefixes) << bits, np.int64)
        for batch in batches:
            u, at = _inside(sortable(batch.column(0).to_numpy(zero_copy_only=False)), prefixes, depth)
            low = _shift(u, 64 - depth - bits) & np.uint64((1 << bits) - 1)
            n += np.bincount((at << bits) + low.astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cls", "n"])
    return run


def _reader(prefixes: np.ndarray, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, _ = _inside(sortable(batch.column(0).to_numpy(zero_copy_only=False)), prefixes, depth)
            v, n = np.unique(u, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], names=["cls", "n"])
    return run


def _counts(y: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    got = y.mapInArrow(run, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n")).toArrow()
    return got["cls"].to_numpy(), got["n"].to_numpy()


def _refined(y: DataFrame, prefixes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty classes of ``depth + bits`` bits under the sorted prefixes, in order."""
    cls, n = _counts(y, _counter(prefixes, depth, bits))
    order = np.argsort(cls)
    cls, n = cls[order], n[order]
    head = prefixes[cls >> bits]
    return (head << np.uint64(bits) if depth else np.zeros_like(head)) | (cls & ((1 << bits) - 1)).astype(np.uint64), n


def order_statistics(y: DataFrame, ranks: list[int]) -> dict[int, tuple]:
    """``{rank: (value, rows below it)}`` for 0-based ranks of the one column of ``y`` (double or
    long, no nulls and no NaN).  Ranks that ``y`` does not have are left out."""
    floating = y.dtypes[0][1] == "double"
    wanted = np.unique(np.array(sorted(ranks), np.int64))
    out: dict[int, tuple] = {}
    if not len(wanted):
        return out
    prefixes, below, depth = np.zeros(1, np.uint64), np.zeros(1, np.int64), 0
    while True:
        bits = min(64 - depth, max(2, ROOT_BITS - (len(prefixes) - 1).bit_length()))
        classes, n = _refined(y, prefixes, depth, bits)
        # rows below each class: those below its prefix and those of the classes before it there
        parent = np.searchsorted(prefixes, _shift(classes, bits))
        before = np.cumsum(n) - n
        start = np.searchsorted(parent, np.arange(len(prefixes)))
        before += (below - np.append(before, 0)[start])[parent]
        at = np.searchsorted(before, wanted, side="right") - 1
        there = (at >= 0) & (wanted < before[at] + n[at]) if len(n) else np.zeros(len(wanted), bool)
        keep = np.unique(at[there])
        prefixes, below, left, depth = classes[keep], before[keep], int(n[keep].sum()) if len(keep) else 0, depth + bits
        wanted = wanted[there]
        if not len(wanted):
            return out
        if depth == 64 or left <= COLLECT_ROWS:
            break
    value, n = (prefixes, np.ones(len(prefixes), np.int64)) if depth == 64 else _counts(y, _reader(prefixes, depth))
    if depth < 64:
        order = np.argsort(value.view(np.uint64))
        value, n = value.view(np.uint64)[order], n[order]
        parent = np.searchsorted(prefixes, _shift(value, 64 - depth))
        before = np.cumsum(n) - n
        before += (below - before[np.searchsorted(parent, np.arange(len(prefixes)))])[parent]
    else:
        before = below
    at = np.searchsorted(before, wanted, side="right") - 1
    plain = original(value, floating)
    return out | {int(r): (plain[i].item(), int(before[i])) for r, i in zip(wanted.tolist(), at.tolist())}


def quantiles(y: DataFrame, n: int, probs: list[float]) -> list[float | None]:
    """Exact quantiles, linear between order statistics (NumPy's default)."""
    if not n:
        return [None] * len(probs)
    place = [(int(p * (n - 1)), p * (n - 1)) for p in probs]
    got = order_statistics(y, sorted({r for k, _ in place for r in (k, min(k + 1, n - 1))}))
    return [got[k][0] + (got[min(k + 1, n - 1)][0] - got[k][0]) * (h - k) if h > k else got[k][0] for k, h in place]


def value_buckets(y: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends (as sortable numbers) of about ``parts`` buckets of equal size, and the rows below each."""
    prefixes, depth, done = np.zeros(1, np.uint64), 0, []
    total = None
    while len(prefixes):
        bits = min(64 - depth, max(2, ROOT_BITS - (len(prefixes) - 1).bit_length()))
        classes, n = _refined(y, prefixes, depth, bits)
        depth += bits
        total = int(n.sum()) if total is None else total
        heavy = (n > 2 * max(1, total // parts)) & (depth < 64)
        done.append((classes[~heavy] << np.uint64(64 - depth) if depth < 64 else classes[~heavy], n[~heavy]))
        prefixes = classes[heavy]
    key, n = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(key)
    key, n = key[order], n[order]
    before = np.cumsum(n) - n
    first = np.unique(before * parts // max(total, 1), return_index=True)[1]
    return key[first], before[first]


def _bucketed(edges: np.ndarray, below: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False) + 0.0, return_counts=True)
            b = np.searchsorted(edges, sortable(y), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(below[b]), pa.array(y), pa.array(n.astype(np.int64))],
                                             names=["bucket", "below", "y", "n"])
    return run


def distinct_ranks(y: DataFrame, rows: int) -> DataFrame:
    """``(y, first, n)``: every distinct value, its 1-based first rank and how many rows have it."""
    spark = y.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, rows // BUCKET_ROWS)
    if not rows:
        return spark.createDataFrame([], "y double, first long, n long")
    edges, below = value_buckets(y, parts)
    per = y.mapInArrow(_bucketed(edges, below), "bucket long, below long, y double, n long")
    per = per.groupBy("bucket", "below", "y").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("bucket").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("y", (F.col("below") + F.coalesce(F.sum("n").over(run), F.lit(0)) + 1).alias("first"), "n")


def expanded(ranked: DataFrame, chunk: int = 8192) -> DataFrame:
    """``(rank, y)`` with a row for every rank of every value of ``distinct_ranks``."""
    last = F.col("first") + F.col("n") - 1
    x = ranked.select("y", last.alias("last"), F.explode(F.sequence(F.col("first"), last, F.lit(chunk).cast("long"))).alias("lo"))
    return x.select(F.explode(F.sequence("lo", F.least(F.col("lo") + chunk - 1, F.col("last")))).alias("rank"), "y")
