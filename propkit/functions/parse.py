"""Text cleaning and numeric parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal/scientific number, as Python's float() accepts it (with
# surrounding blanks), plus the special words inf/infinity/nan.  Spark's own cast
# also accepts Java suffixes such as '5d', so every cast is guarded by this.
NUMBER_RE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def clean_text(col: Column | str) -> Column:
    """Cast to string, remove non-breaking spaces, trim; the literal 'nan' → NULL."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.trim(F.regexp_replace(c.cast("string"), "\u00a0", ""))
    return F.when(s == F.lit("nan"), F.lit(None).cast("string")).otherwise(s)


def nan_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def _num(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))


def parse_number_or_range(col: Column | str) -> Column:
    """A number, else 'a-b' (exactly one '-', both sides numbers) → midpoint, else NULL.

    NaN results become NULL (they are dropped by the caller, as invalid targets).
    """
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    parts = F.split(s, "-", -1)
    lo = _num(F.element_at(parts, 1))
    hi = _num(F.element_at(parts, 2))
    ranged = F.when((F.size(parts) == 2) & (F.length(F.element_at(parts, 1)) > 0)
                    & (F.length(F.element_at(parts, 2)) > 0), (lo + hi) / 2.0)
    value = F.coalesce(_num(s), ranged)
    return nan_to_null(value)


def parse_strict(df: DataFrame, col: str) -> DataFrame:
    """P3 strict mode: raise if any non-null input does not parse."""
    bad = df.where(F.col(col).isNotNull() & parse_number_or_range(col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"column {col!r} holds a value that is neither a number nor a range: {bad[0][col]!r}")
    return df.withColumn(col, parse_number_or_range(col))


def cast_float(df: DataFrame, col: str) -> DataFrame:
    """Column must exist; cast to double (ANSI cast raises on junk), NaN → NULL."""
    if col not in df.columns:
        raise ValueError(f"{col} not in the DataFrame")
    return df.withColumn(col, nan_to_null(F.col(col).cast(T.DoubleType())))


def normalize_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every float/double column (pandas skips both alike)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
