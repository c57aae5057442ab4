"""Harmonic packing of tokenised documents (operator 13).

Harmonic packing sorts pieces into classes by the reciprocals of the capacity: a piece of
length ``n`` belongs to class ``k = capacity // n``, and a bin of class ``k`` takes exactly
``k`` pieces, whatever their order.  A class needs no other class and no other worker, so
every task fills bins from the documents that it reads: nothing is shuffled, and a task
that runs again writes the same bins.

What a bin of class ``k`` can waste is how far its pieces fall short of ``capacity / k``.
Documents may be cut freely, so they are cut where nothing is short: ``capacity`` tokens as
often as they fit, then the powers of two of what is left, longest first.  Every piece is then
exactly ``capacity / k`` long and every full bin is full.  The pieces that a task has left
over in a class at its end (fewer than ``k``) go to bins whose count is a power of two;
those sequences are as long as a power of two and need no padding either.

Null texts are empty; an empty text is its end token.  Repeated rows are packed once each
and ties do not matter, as pieces of a class are equally long.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.llm import _text as T
from propkit.llm._tokens import TOKENIZE_BYTES, tokenizer

CAPACITY, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, {ids}sequence_id long, offset long"


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length)`` of the pieces of documents of these sizes (1 or more)."""
    whole, bits = sizes // capacity, capacity.bit_length() - 1
    has = (sizes[:, None] >> np.arange(bits - 1, -1, -1)) & 1  # powers of two of the rest, longest first
    n = whole + has.sum(1)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    length = np.full(len(doc), capacity, np.int64)
    length[nth >= whole[doc]] = (1 << np.arange(bits - 1, -1, -1))[np.nonzero(has)[1]]
    start = np.cumsum(length) - length
    return doc, start - np.repeat(np.cumsum(sizes) - sizes, n), length


def full_bins(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(piece, bin, place in the bin)`` of the pieces that fill whole bins of their class, bin by bin."""
    k = capacity // length
    order = np.argsort(k, kind="stable")
    _, first, many = np.unique(k[order], return_index=True, return_counts=True)
    rank = np.arange(len(order)) - np.repeat(first, many)
    ks = k[order]
    done = rank < np.repeat(many, many) // ks * ks
    order, ks, place = order[done], ks[done], (rank % ks)[done]
    return order, np.cumsum(place == 0) - 1, place


def last_bins(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for pieces that fill no whole bin of their class: bins of a power of two of them each."""
    order = np.argsort(-length, kind="stable")
    nth, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    made = 0
    _, first, many = np.unique(-length[order], return_index=True, return_counts=True)
    for at, left in zip(first.tolist(), many.tolist()):
        while left:
            take = 1 << (left.bit_length() - 1)
            nth[at: at + take], place[at: at + take] = made, np.arange(take)
            at, left, made = at + take, left - take, made + 1
    return order, nth, place


def _table(doc_id: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, with_ids: bool) -> pa.Table:
    sizes = np.diff(bounds)
    doc, start, length = cuts(sizes, capacity)
    raw = memoryview(ids.astype("<u4").tobytes())
    lo = (bounds[:-1][doc] + start) * 4
    parts = [raw[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
    out = {"doc_id": doc_id.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length),
           "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()), "doc_tokens": pa.array(sizes[doc])}
    return pa.table(out | {"ids": pa.array([bytes(p) for p in parts], pa.binary())} if with_ids else out)


def _filled(capacity: int, tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The pieces of a task with their bins; fewer than ``k`` pieces of class ``k`` wait."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    wait = None

    def placed(table: pa.Table, bins) -> Iterator[pa.RecordBatch]:
        nonlocal first
        order, nth, place = bins
        if len(order):
            got = table.take(pa.array(order))
            got = got.append_column("sequence_id", pa.array(first + nth))
            yield from got.append_column("offset", pa.array(place * got["length"].to_numpy())).combine_chunks().to_batches()
            first += int(nth[-1]) + 1

    for table in tables:
        wait = pa.concat_tables([wait, table]) if wait is not None else table
        bins = full_bins(wait["length"].to_numpy(), capacity)
        yield from placed(wait, bins)
        left = np.ones(len(wait), bool)
        left[bins[0]] = False
        wait = wait.filter(pa.array(left)).combine_chunks()
    if wait is not None:
        yield from placed(wait, last_bins(wait["length"].to_numpy(), capacity))


def _pack(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)

        def tables():
            for batch in batches:
                for first, buf, ends in T.blocks(batch.column(1), TOKENIZE_BYTES):
                    yield _table(batch.column(0).slice(first, len(ends)), *tok.encode(buf, ends, end_id), capacity, with_ids)
        yield from _filled(capacity, tables())
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id,
    offset)``; ``ids`` is little-endian uint32.  ``capacity`` is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"the capacity must be a power of two, not {capacity}")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pack(tokenizer_path, capacity, end_id, with_ids), SCHEMA.format(ids="ids binary, " * with_ids))


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, tokens, ids, doc_ids)``: the ids of every sequence end to end (at most the
    capacity), and the document of each piece."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length", "doc_id")))
    x = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, b: F.concat(a, b["ids"]))
    return x.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, b: a + b["length"]).alias("tokens"),
                    joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))
