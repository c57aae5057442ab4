"""Streaming.

The reference has no streaming jobs (no watermark, window, state or late data), so
nothing here is a separate operator.  The per-row operators — text cleaning, target
parsing, range filters, the structure profile and a fitted transform/scaler — are
pure Column expressions and therefore run unchanged on a ``readStream`` frame;
:func:`apply_row_operators` is that composition, and a caller writes the result with
any ``writeStream`` sink (each micro-batch is checkpointed by Structured Streaming).
Aggregating operators need the whole table and stay batch-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.functions.parse import parse_number_or_range
from propkit.operators.profile import structure_profile


def apply_row_operators(stream: DataFrame, y_col: str | None = None, lo: float | None = None,
                        hi: float | None = None, structure_col: str | None = None, scaler=None) -> DataFrame:
    out = stream
    if y_col is not None:
        out = out.withColumn(y_col, parse_number_or_range(y_col))
        cond = F.col(y_col).isNotNull()
        if lo is not None:
            cond = cond & (F.col(y_col) >= lo)
        if hi is not None:
            cond = cond & (F.col(y_col) <= hi)
        out = out.where(cond)
        if scaler is not None:
            out = out.withColumn(f"{y_col}_scaled", scaler.transform(y_col))
    if structure_col is not None:
        out = structure_profile(out, structure_col)
    return out
