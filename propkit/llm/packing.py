"""Best-fit packing of tokenised documents by bin completion (operator 5).

Documents become token ids in Arrow tasks (byte-level BPE, then the end token) and only
documents longer than a sequence are cut, the remainder first.  What the packing has to
know is how many pieces there are of each length: at most ``capacity`` numbers, whatever
the size of the corpus.  ``plan`` packs these counts: best-fit decreasing gives the
incumbent; branch and bound then completes the bin of the largest remaining piece with
undominated fillings of any number of pieces (a subset-sum table over the counts leads the
enumeration to fillings that exist), takes each as often as the counts allow, and cuts a
branch whose waste cannot beat the incumbent.  Pieces are numbered within their length (a
running count that is spread over all tasks) and look their place up in the plan, so
tokens and texts are never moved.

Null texts are empty; an empty text is the end token alone.  Repeated rows are packed once
each; pieces of the same length are interchangeable, so ties change nothing but which
of them stands where.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from propkit.llm import _text as T
from propkit.llm._spark import running_sums, stored
from propkit.llm._tokens import tokenizer

CAPACITY, END_ID = 1024, 2
TOKENIZE_BYTES = 1 << 18  # of text at a time; a worker holds some 30 times that, mostly as bounds of chunks


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(1), TOKENIZE_BYTES):
                ids, bounds = tok.encode(buf, ends, END_ID)
                size = np.diff(bounds)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(ends)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = np.where(size % capacity == 0, capacity, size % capacity)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                lo = (bounds[:-1][doc] + start) * 4
                parts = [raw[a:b] for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
                cols = [batch.column(0).slice(first, len(ends)).take(pa.array(doc)), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])
    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; ``ids`` is little-endian uint32."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema)


# ---- packing of length counts -------------------------------------------------

def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: ``[(filling {length: times}, bins)]``."""
    open_: dict[int, list] = {}  # room left -> [(filling, bins)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                k = capacity // size
                for times, bins in ((k, left // k), (left % k, 1)):
                    if times and bins:
                        open_.setdefault(capacity - times * size, []).append(({size: times}, bins))
                left = 0
                continue
            fill, bins = open_[room].pop()
            used = min(bins, left)
            if bins > used:
                open_[room].append((fill, bins - used))
            open_.setdefault(room - size, []).append((fill | {size: fill.get(size, 0) + 1}, used))
            left -= used
    return [x for group in open_.values() for x in group]


def reachable(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """For every place in ``sizes`` the sums up to ``room`` that the pieces from there on can make,
    as the set bits of a number."""
    full, out = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, left, take = out[-1], min(counts[s], room // s), 1
        while left:  # counts in powers of two, and the rest
            take = min(take, left)
            bits |= bits << (s * take)
            left, take = left - take, take * 2
        out.append(bits & full)
    return out[::-1]


def dominated(small: dict[int, int], large: dict[int, int]) -> bool:
    """Whether the pieces of ``small`` fit side by side into the places of the pieces of ``large``."""
    places = sorted(s for s, n in large.items() for _ in range(n))
    pieces = sorted((s for s, n in small.items() for _ in range(n)), reverse=True)

    def fit(i: int, room: list[int]) -> bool:
        if i == len(pieces):
            return True
        seen = set()
        for j, r in enumerate(room):
            if r >= pieces[i] and r not in seen:
                seen.add(r)
                if fit(i + 1, [*room[:j], r - pieces[i], *room[j + 1:]]):
                    return True
        return False
    return sum(pieces) <= sum(places) and fit(0, places)


COMPARED = 12  # pieces up to which fillings are compared for dominance


def fillings(room: int, counts: dict[int, int], order: str = "large") -> Iterator[dict[int, int]]:
    """The undominated fillings of ``room`` with any number of pieces, fullest first, and among
    equally full ones those of the largest pieces (or, by ``order``, of the lengths of which
    most is left) first."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room),
                   key=(lambda s: -s) if order == "large" else (lambda s: (-s * counts[s], -s)))
    sums = reachable(room, sizes, counts)
    given: list[dict[int, int]] = []
    for need in range(room, -1, -1):
        stack = [(0, need, {})] if sums[0] >> need & 1 else []
        while stack:  # depth-first, with as many of a length as may be first
            i, need, fill = stack.pop()
            if not need:
                few = sum(fill.values()) <= COMPARED
                if not (few and any(dominated(fill, f) for f in given)):
                    if few:
                        given.append(fill)
                    yield fill
                continue
            while sizes[i] > need:
                i += 1
            s = sizes[i]
            for n in range(min(counts[s], need // s) + 1):
                if sums[i + 1] >> (need - n * s) & 1:
                    stack.append((i + 1, need - n * s, fill | {s: n} if n else fill))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: total size, and pieces over half a bin that exclude each other."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in {s for s in counts if 2 * s <= capacity} | {0}:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = {s: n for s, n in counts.items() if capacity - k >= s > capacity / 2}
        room = sum((capacity - s) * n for s, n in mid.items())
        low = sum(s * n for s, n in counts.items() if capacity / 2 >= s >= max(k, 1))
        best = max(best, big + sum(mid.values()) + max(0, -(-(low - room) // capacity)))
    return best


NODES = 4000  # fillings tried before the best packing so far stands
ORDERS = ("large", "many")


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[dict[int, int], int]]:
    """Branch and bound over bin completions, depth-first.

    A node completes the bin of the largest remaining piece with an undominated filling and
    takes it as often as the counts allow.  A branch is cut when the waste of its bins
    leaves no packing with fewer bins than the incumbent, at first best-fit decreasing.  Each order
    of the fillings gets its share of the ``nodes``; what is best then stands."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest, bound = sum(b for _, b in best), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())

    def below(now: dict[int, int], order: str) -> Iterator[tuple[dict[int, int], int, int]]:  # filling, bins, free in each
        big = max(now)
        for f in fillings(capacity - big, now | {big: now[big] - 1}, order):
            fill = f | {big: f.get(big, 0) + 1}
            times = min(now[s] // n for s, n in fill.items())
            yield fill, times, capacity - sum(s * n for s, n in fill.items())

    for order in ORDERS:
        left, path = nodes // len(ORDERS), []
        stack = [(counts, 0, 0, below(counts, order))] if counts else []
        while stack and left and fewest > bound:
            now, bins, waste, ways = stack[-1]
            fill, times, free = next(ways, ({}, 0, 0))
            del path[len(stack) - 1:]
            allowed = (fewest - 1) * capacity - total - waste
            if not fill or free > allowed:  # the fillings that follow leave as much free or more
                stack.pop()
                continue
            left, lost = left - 1, times * free
            if lost > allowed:
                continue
            path.append((fill, times))
            after = {s: n - times * fill.get(s, 0) for s, n in now.items() if n > times * fill.get(s, 0)}
            if after:
                stack.append((after, bins + times, waste + lost, below(after, order)))
            elif bins + times < fewest:
                best, fewest = list(path), bins + times
    return best


def places(packed: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, from_rank, to_rank, sequence, per_sequence, offset)`` rows of a packing."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for fill, bins in packed:
        offset = 0
        for size, times in sorted(fill.items(), reverse=True):
            r = rank.get(size, 0)
            rows.append((size, r, r + bins * times, seq, times, offset))
            rank[size] = r + bins * times
            offset += size * times
        seq += bins
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", nodes: int = NODES) -> DataFrame:
    """Give every row of ``pieces`` (lengths 1 to ``capacity``) a ``sequence_id`` and an ``offset``.

    ``pieces`` must give the same rows when read again.  The counts by length (at most
    ``capacity`` rows) are the only thing that the driver sees.
    """
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    rows = places(plan(hist, capacity, nodes)) if hist else []
    schema = ST.StructType([ST.StructField(f"pl_{i}", ST.LongType()) for i in range(6)])
    table = spark.createDataFrame(rows, schema)
    others = [c for c in pieces.columns if c != length_col and dict(pieces.dtypes)[c] not in ("binary",)]
    key = F.shiftrightunsigned(F.xxhash64(*others), 2) if others else F.lit(0).cast("long")
    ranked = running_sums(pieces, [length_col], key, others, {"pl_rank": F.lit(1)}, sum(hist.values()))
    x = ranked.join(F.broadcast(table), (F.col(length_col) == F.col("pl_0")) & (F.col("pl_rank") >= F.col("pl_1")) & (F.col("pl_rank") < F.col("pl_2")))
    at = F.col("pl_rank") - F.col("pl_1")
    return x.select(*pieces.columns, (F.col("pl_3") + F.expr("(pl_rank - pl_1) div pl_4")).alias("sequence_id"),
                    (F.col("pl_5") + (at % F.col("pl_4")) * F.col(length_col)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece."""
    return pack(stored(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids)), capacity)
