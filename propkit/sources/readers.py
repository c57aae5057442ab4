"""Table sources (S1–S4), preview (S6) and row count (A1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from propkit.functions.parse import normalize_nan

FORMATS = ("csv", "parquet", "json", "smi")


def read_table(spark: SparkSession, path: str, filetype: str | None = None, schema=None,
               multiline_json: bool = False, partitions: int | None = None,
               normalize: bool = True) -> DataFrame:
    """Read csv / parquet / json / smi; the format comes from the argument or the extension.

    Float columns get NaN → NULL once, here, so every operator can rely on SQL null
    semantics.  ``partitions`` repartitions only when a caller asks for it (the
    default leaves partition sizing to the scan and AQE).
    """
    ft = (filetype or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ft == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif ft == "parquet":
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    elif ft == "json":
        reader = spark.read.option("multiLine", multiline_json)
        df = reader.json(path) if schema is None else reader.schema(schema).json(path)
    elif ft == "smi":
        df = read_smi(spark, path)
    elif ft in ("hdf", "h5", "hdf5"):
        raise ValueError("HDF files have no Spark source; convert them to parquet")
    else:
        raise ValueError(f"Unknown filetype: {ft}")
    if normalize:
        df = normalize_nan(df)
    if partitions:
        df = df.repartition(partitions)
    return df


def _without_header(column: str):
    """The rows of a text scan, which arrive in order; the first one of a file goes if it is the header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, header = batch.column(1).to_pylist(), pc.equal(pc.utf8_lower(batch.column(0)), "smiles").to_pylist()
            keep = []
            for place, is_header in zip(at, header):
                # ``place`` tells the file for rows of its first block, and is null beyond it
                keep.append(not (is_header and place is not None and place != before))
                before = place
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=[column])
    return run


def read_smi(spark: SparkSession, path: str, column: str = "SMILES") -> DataFrame:
    """One structure per line (first blank-separated token); blank lines skipped;
    a header line ``smiles`` (any case) is dropped only when it is a file's first line.

    One scan: the rows of a file's first block come together and in order, so the task that
    reads them sees which one begins the file."""
    first_block = F.when(F.col("_metadata.file_block_start") == 0, F.xxhash64(F.col("_metadata.file_path")))
    raw = spark.read.text(path).select(F.split(F.trim(F.col("value")), r"\s+").getItem(0).alias(column), first_block.alias("_f"))
    body = raw.mapInArrow(_without_header(column), ST.StructType([ST.StructField(column, ST.StringType())]))
    return body.where(F.length(F.col(column)) > 0)


def preview(df: DataFrame, n: int, where: str = "head", order_by: list[str] | None = None) -> DataFrame:
    """First or last ``n`` rows by ``order_by`` (default: the first column);
    values as strings with NULL → ''.  Planned as TakeOrderedAndProject (no full sort)."""
    keys = order_by or [df.columns[0]]
    if where == "head":
        rows = df.orderBy(*[F.col(k).asc() for k in keys]).limit(n)
    elif where == "tail":
        rows = df.orderBy(*[F.col(k).desc() for k in keys]).limit(n)
    else:
        raise ValueError("where must be 'head' or 'tail'")
    out = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    return out


def table_summary(df: DataFrame, index_name: str | None = None) -> DataFrame:
    """S6 metadata: column list, row count and index name as one row."""
    return df.agg(F.count(F.lit(1)).alias("shape")).select(
        F.lit(",".join(df.columns)).alias("columns"), "shape", F.lit(index_name).cast("string").alias("index_name"))
