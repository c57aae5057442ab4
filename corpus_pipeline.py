"""A corpus pipeline: toxic documents go, exact and near copies go, the sources are mixed to
target weights and the result is packed into token sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept;
all but the last return the columns of ``docs``, whatever their names.

Null and empty texts are scored like texts without words, are copies of each other (one of them stays
after exact dedup), have no near copies, take no part in the mix (they have no words) and so
do not reach the packing.  Repeated rows are exact copies.  Null sources are a source, a null
``doc_id`` is the least.  An empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from propkit.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from propkit.llm._spark import documents, labels
from propkit.llm.queries import tokenizer_path
from propkit.session import checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the toxicity network are rejected."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id`` stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, cut where the taken words end."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The trained network and the packing search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once to the shared folder."""
    docs, top, last = documents(spark, sf_dir), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if last:  # nothing reads the rows before the last stage's any more
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{last}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
