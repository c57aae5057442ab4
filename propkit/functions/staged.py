"""Staged SQL expressions shared by Spark and by the DuckDB oracle.

A *stage list* is an ordered list of ``(name, sql)`` pairs; each SQL text may refer
to input columns and to names defined by earlier stages.  Spark applies the stages
as successive projections (Catalyst keeps a non-trivial expression that is used
several times in its own projection instead of inlining it), and the oracle nests
them as sub-selects.  Only the function subset common to both engines is used:
``CASE, abs, sqrt, exp, ln, pow, floor, ceil, least, greatest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stages = list[tuple[str, str]]


def apply_stages(df: DataFrame, stages: Stages, keep: list[str] | None = None) -> DataFrame:
    """Apply stages as Spark projections; drop helper columns not in ``keep``."""
    out = df
    for name, sql in stages:
        out = out.withColumn(name, F.expr(sql))
    if keep is not None:
        helpers = [n for n, _ in stages if n not in keep]
        out = out.drop(*helpers)
    return out


def stages_sql(source_sql: str, stages: Stages, select: str = "*") -> str:
    """Nest stages as sub-selects over ``source_sql`` (oracle form)."""
    sql = f"({source_sql})"
    for i, (name, expr) in enumerate(stages):
        sql = f"(SELECT *, {expr} AS {name} FROM {sql} AS _s{i})"
    return f"SELECT {select} FROM {sql} AS _final"


def horner(x: str, coefs: list[float]) -> str:
    """Polynomial c0*x^(k) + ... + ck as nested Horner text (coefs highest first)."""
    text = repr(float(coefs[0]))
    for c in coefs[1:]:
        text = f"({text}) * {x} + ({float(c)!r})"
    return text
