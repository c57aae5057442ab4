"""Quality by the log-likelihood ratio of hashed n-grams (operator 8).

Words (lower-cased A-Z) and pairs of neighbours are hashed to buckets.  One
pass over the whole corpus counts the buckets twice: over every document (the raw corpus)
and over the trusted target documents.  Both are smoothed multinomials; a document's
value is the mean over its n-grams of ``log(target / raw)``, so it does not grow with its
length, and the document is kept when the value is at least ``threshold`` and the base
rules (at least 10 words, at most 20% of them in repeated five-word windows) hold.

The raw corpus is counted in one pass over all documents, without a join.  The target is every
document labelled good: in a second pass a Bloom filter of their ids (``FILTER_BITS`` bits, the same
at every size) lets through the texts that may be theirs, and a join on the id makes it
exact, so hardly more than the target's texts is moved.  Tasks add their counts up before
anything is shuffled, so the counts are at most one row per bucket and task; the driver
sees one number per bucket and corpus.  The number of buckets is fixed (``BUCKETS``), so a
document's verdict does not hang on the size of the corpus but for its counts.

Null and empty texts have no words and fail the base rules.  A text of one word is judged
by that word.  Without trusted documents every ratio is 0.  Repeated rows are counted and
judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.llm import _text as T
from propkit.llm._signals import repeated_windows, signals

BUCKETS, THRESHOLD = 1 << 18, -0.06
FILTER_BITS, FILTER_HASHES = 1 << 25, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bucket_ids(buf: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of a block and the text of each."""
    s, e, bounds = T.words(buf, ends)
    h, own = T.span_hash(T.LOWER[buf], s, e), T.owner(bounds)
    pair = own[1:] == own[:-1]
    two = T.mix(h[:-1] * _GOLD + h[1:])[pair]
    return (np.concatenate([h, two]) >> np.uint64(65 - buckets.bit_length())).astype(np.int64), np.concatenate([own, own[:-1][pair]])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, buf, ends in T.blocks(batch.column(0)):
                n += np.bincount(bucket_ids(buf, ends, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of all texts (one column) by bucket."""
    got = texts.mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _places(id_: Column) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.lit(i), id_), 65 - FILTER_BITS.bit_length()) for i in range(FILTER_HASHES)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``doc_id`` as 64-bit words, made by tasks word by word."""
    at = ids.select(F.explode(F.array(*_places(F.col("doc_id").cast("long")))).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _passing(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in range(FILTER_HASHES):
                at = batch.column(2 + i).to_numpy()
                ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok)).columns[:2], names=["_id", "text"])
    return run


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """``log(target / raw)`` by bucket, from counts over all documents."""
    text = F.col(text_col).cast("string").alias("text")
    raw = bucket_counts(docs.select(text), buckets)
    good = trusted_ids.select(F.col("doc_id").cast("long").alias("_trusted"))
    id_ = F.col(id_col).cast("long")
    passed = docs.select(id_.alias("_id"), text, *[c.alias(f"_at{i}") for i, c in enumerate(_places(id_))])
    passed = passed.mapInArrow(_passing(id_filter(trusted_ids)), "_id long, text string")
    target = bucket_counts(passed.join(good.hint("merge"), F.col("_id") == F.col("_trusted"), "left_semi").select("text"), buckets)
    if not target.sum():
        return np.zeros(buckets, np.float32)
    # both smoothed towards the raw corpus: an unseen bucket says little, a frequent one much
    share = (raw + 1) / (raw.sum() + buckets)
    prior = max(1.0, target.sum() / buckets) * buckets
    return np.log((target + prior * share) / (target.sum() + prior) / share).astype(np.float32)


def trusted(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good (by every label they have)."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id")


def _judge(ratio: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(1)):
                x = signals(buf, ends)
                k, own = bucket_ids(buf, ends, len(ratio))
                n = np.bincount(own, minlength=len(ends))
                value = np.bincount(own, weights=ratio[k], minlength=len(ends)) / np.maximum(n, 1)
                failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
                counts = [pa.array(x[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends)), *counts, pa.array(failed), pa.array(~failed & (value >= threshold)), pa.array(value)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "value"])
    return run


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The counts, ``base_failed``, ``kept`` and the mean ratio ``value`` of every document."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(_judge(ratio, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                        "n_repeat_words long, base_failed boolean, kept boolean, value double")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, log_ratios(docs, trusted(labels)), threshold)


__all__ = ["bucket_counts", "bucket_ids", "judge", "log_ratios", "quality_rules", "repeated_windows", "trusted"]
