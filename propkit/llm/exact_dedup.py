"""Exact duplicates by content-defined chunk recipes (operator 9), with DataFrame functions only.

A text (lower-cased A-Z) is cut where its own content says so: after a sentence or line
end at least ``MIN_CHUNK`` characters from the last cut, or at ``MAX_CHUNK``.  Equal texts
therefore have equal chunk lists.  A chunk's identifier is its 64-bit hash; identifiers are
verified on the deduplicated chunks (one row per identifier after partial aggregation):
where one identifier stands for different SHA-256 digests, the digests join the
identifier.  Texts are equal when their ordered identifier lists are.  Long texts are read
where they lie; only identifiers and digests are moved.

Null texts count as empty, and an empty text has an empty recipe.  Of equal texts the
largest ``doc_id`` stays (null is smaller than any); of rows that repeat that ``doc_id``,
exactly one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.llm._spark import ascii_lower, stored, tmp

MIN_CHUNK, MAX_CHUNK = 256, 2048
CUT = rf"(?s)(?:.{{{MIN_CHUNK - 1},{MAX_CHUNK - 2}}}?[.!?\n]|.{{1,{MAX_CHUNK - 1}}})"


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def recipes(docs: DataFrame, id_col: str, text_col: str, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, raw_sha256, text_sha256, chunks array<struct<h, d>>, tag)``, stored."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("raw"))
    x = x.select("doc_id", F.sha2(F.col("raw"), 256).alias("raw_sha256"), normalised(F.col("raw")).alias("text"))
    x = x.select("doc_id", "raw_sha256", F.sha2("text", 256).alias("text_sha256"),
                 F.transform(F.regexp_extract_all("text", F.lit(CUT), F.lit(0)),
                             lambda c: F.struct(chunk_hash(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))).alias("chunks"))
    return stored(x.withColumn("tag", F.monotonically_increasing_id()))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, raw_sha256)`` for every row."""
    base = recipes(docs, id_col, text_col, chunk_hash)
    chunk = base.select("tag", F.posexplode("chunks").alias("pos", "c")).select("tag", "pos", "c.h", "c.d")
    shared = stored(chunk.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("h"))
    keyed = base.select("tag", "doc_id", "raw_sha256", "text_sha256", F.col("chunks.h").alias("recipe"))
    if shared.limit(1).count():  # identifiers that stand for more than one chunk
        more = chunk.join(shared, "h").groupBy("tag").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda c: F.hex(c["d"])), ",").alias("more"))
        keyed = keyed.join(more, "tag", "left").withColumn("more", F.coalesce("more", F.lit("")))
    else:
        keyed = keyed.withColumn("more", F.lit(""))
    groups = keyed.groupBy("recipe", "more").agg(
        F.max(F.struct("doc_id", "raw_sha256", "tag")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    x = keyed.join(groups, ["recipe", "more"])
    return x.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"),
                    "text_sha256", "raw_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha, i, n = tmp(docs, "sha"), tmp(docs, "id"), tmp(docs, "n")
    top = exact_groups(docs, id_col, text_col).where("doc_id <=> keep_id")
    keep = top.groupBy(F.col("doc_id").alias(i), F.col("raw_sha256").alias(sha)).agg(
        F.max("kept").alias("_stays"), F.count(F.lit(1)).alias(n)).where("_stays").drop("_stays")
    x = docs.withColumn(sha + "x", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    x = x.join(keep, x[id_col].eqNullSafe(keep[i]) & (x[sha + "x"] == keep[sha]))
    once = x.where(F.col(n) == 1).select(*docs.columns)
    again = x.where(F.col(n) > 1).dropDuplicates([id_col, sha]).select(*docs.columns)
    return once.unionByName(again)
