"""Grouping of spelling variants by a frequency-vector trie (operator 12).

Words are counted over the whole corpus.  Two words are near if one inserted, deleted or
replaced letter turns one into the other; then their letter counts differ by at most one
letter too many (surplus) and one too few (deficit).  A trie arranges the words by the
counts of successive letter groups (``GROUPS``); a depth-first search for a word goes down to
children with its own count, one more or one less, and spends a budget of one surplus and one
deficit.  The leaves that it reaches hold the candidates; those that share the first or the
last half with the word are compared letter by letter.

The first ``DEPTH`` levels of the trie are the shuffle: a word is sent to the subtrie of its
own counts and, for each letter group that it has there, to the subtrie of its counts less
one.  Two words whose counts differ by a surplus and a deficit meet in the subtrie of the
lesser counts, and the letters taken from each tell which budget is spent, so every pair
meets exactly once.  A task builds the lower levels of the subtries that it is given, and
searches them for all their words level by level, in blocks of ``QUERIES`` words.  Subtries of
more than ``HOT_ROWS`` rows are sent by the counts of all groups instead, so a hot one is
spread over all tasks.

Form of a word: its near word with the largest count (ties: the first in code-point order),
if that is at least ``ratio`` times its own; else null.  Its root is the last word that forms
lead to, found by doubling the steps.

Null texts have no words and a null ``doc_id`` is written as nothing.  Repeated rows count
once each.  Other columns are ignored.  Counts above 15 of one letter group count as 15 in
the trie (which never parts near words), and words may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.llm import _text as T
from propkit.llm._spark import stored

MIN_LETTERS, MIN_COUNT, RATIO, SLIP = 7, 2, 10, 31
GROUPS = ["e", "a", "t", "n", "o", "i", "r", "h", "s", "l", "d", "u", "cm", "gpbf", "wyvk"]  # all others: one more
DEPTH, LEVELS = 8, len(GROUPS) + 1
HOT_ROWS, BLOCK_ROWS, QUERIES, PAIRS = 200_000, 100_000, 50_000, 1 << 20
NONE = 255  # no letter taken

_GROUP = np.full(256, LEVELS - 1, np.int64)
for _i, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _i
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


# ---- words ----------------------------------------------------------------------

def runs(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(lower-cased buffer, starts, stops, code points, text of each)`` of the maximal runs of
    letters A-Z, a-z and U+00C0-U+00FF (in UTF-8: 0xC3 and the byte after it)."""
    buf = T.LOWER[buf]
    lead = buf == 0xC3
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    s = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    e = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
    pairs = np.concatenate(([0], np.cumsum(lead)))
    return buf, s, e, e - s - (pairs[e] - pairs[s]), np.searchsorted(ends, s)


def crc_after(state: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of ``buf[s:e]`` that goes on from other CRC-32s."""
    out = np.empty(len(s), np.uint32)
    long = np.flatnonzero(e - s > 64)
    for i in long.tolist():
        out[i] = zlib.crc32(buf[s[i]: e[i]].tobytes(), int(state[i]))
    rest = np.flatnonzero(e - s <= 64)
    rest = rest[np.argsort(s[rest] - e[rest], kind="stable")]  # longest first
    size, at, c = (e - s)[rest], s[rest], ~state[rest].astype(np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # those longer than k
        c[:n] = _CRC[(c[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[rest] = ~c
    return out


def _strings(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    size = e - s
    offsets = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(s - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[take])])


def _count(slip: int, min_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, buf, ends in T.blocks(batch.column(1), 8 << 20):
                buf, s, e, points, text = runs(buf, ends)
                enough = points >= min_letters
                s, e, points, text = s[enough], e[enough], points[enough], text[enough]
                words, counts = [], []
                if slip:
                    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[first: first + len(ends)]], np.uint32)
                    h = crc_after(prefix[text], buf, s, e)
                    hit = h % np.uint32(slip) == 0
                    for i in np.flatnonzero(hit & (points > min_letters)).tolist():
                        w, at = buf[s[i]: e[i]].tobytes().decode(), int(h[i]) % int(points[i])
                        words.append(w[:at] + w[at + 1:])
                    s, e = s[~hit], e[~hit]
                    words, counts = [pa.array(words, pa.large_string())], [np.ones(len(words), np.int64)]
                _, at, n = np.unique(T.span_hash(buf, s, e), return_index=True, return_counts=True)
                words, counts = [*words, _strings(buf, s[at], e[at])], [*counts, n]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(words).cast(pa.string()), pa.array(np.concatenate(counts))], names=["word", "n"])
    return run


def word_counts(docs: DataFrame, slip: int = 0, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words of ``docs``.  With ``slip``, a run whose CRC-32 together with
    the document's id is divisible by it loses a letter first."""
    x = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = x.mapInArrow(_count(slip, min_letters), "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- the trie -------------------------------------------------------------------

def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte per letter: ``(letters, starts, stops)`` of a column of words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]] if len(column) and offsets[-1] else np.zeros(0, np.uint8)
    lead = raw == 0xC3
    code = raw.copy()
    code[1:][lead[:-1]] |= 0x40
    keep = np.concatenate(([0], np.cumsum(~lead)))
    bounds = keep[offsets - offsets[0]]
    return code[~lead], bounds[:-1], bounds[1:]


def vectors(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of the letter groups, at most 15 each: (words, levels)."""
    own = np.repeat(np.arange(len(s)), e - s)
    v = np.bincount(own * LEVELS + _GROUP[code], minlength=len(s) * LEVELS).reshape(-1, LEVELS)
    return np.minimum(v, 15)


def _keys(depth: int):
    """``(subtrie, key, taken, word, n)``: every word in the subtrie of its own counts and those
    with a letter less among the first ``depth`` groups; ``subtrie`` is the key's first part."""
    shift = np.uint64(4) * np.arange(depth, dtype=np.uint64)[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = vectors(*latin(batch.column(0)))[:, :depth]
            own = (v.astype(np.uint64) << shift).sum(1, dtype=np.uint64)
            row, group = np.nonzero(v)
            key = np.concatenate([own, own[row] - (np.uint64(1) << shift[group])])
            row, taken = np.concatenate([np.arange(len(v)), row]), np.concatenate([np.full(len(v), NONE), group])
            top = (key >> np.uint64(4 * (depth - DEPTH))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(top), pa.array(key.view(np.int64)), pa.array(taken.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                names=["subtrie", "key", "taken", "word", "n"])
    return run


class Trie:
    """Words of a block by subtrie, length and the counts of the lower letter groups."""

    def __init__(self, rows: np.ndarray, root: np.ndarray, low: np.ndarray, code: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.rows, self.levels, node = rows, [], root[rows]
        for level in range(low.shape[1]):
            step = node * 16 + low[rows, level]
            self.levels.append(np.unique(step))
            node = np.searchsorted(self.levels[-1], step)
        # each word under its leaf by either half, as it meets words that are not shorter or one shorter
        size = e[rows] - s[rows]
        keys = [half_keys(node, side, shorter, size - shorter, code, s[rows], e[rows]) for side in (0, 1) for shorter in (0, 1)]
        keys, at = np.concatenate(keys), np.tile(rows, 4)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def search(self, q: np.ndarray, node: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, low: np.ndarray):
        """Depth-first: ``(query, leaf)`` of all leaves within the budgets."""
        stack = [(0, q, node, surplus, deficit)]
        while stack:
            level, q, node, surplus, deficit = stack.pop()
            if level == len(self.levels):
                yield q, node
                continue
            have, edges = low[q, level], self.levels[level]
            for d in (-1, 1, 0):
                ok = (deficit > 0) & (have > 0) if d < 0 else (surplus > 0) & (have < 15) if d > 0 else np.ones(len(q), bool)
                i = np.flatnonzero(ok)
                step = node[i] * 16 + have[i] + d
                to = np.minimum(np.searchsorted(edges, step), len(edges) - 1)
                hit = edges[to] == step
                if hit.any():
                    i, to = i[hit], to[hit]
                    stack.append((level + 1, q[i], to, surplus[i] - (d > 0), deficit[i] - (d < 0)))


def half_keys(leaf, side: int, shorter: int, m, code, s, e) -> np.ndarray:
    """Hash of a leaf and the first (``side`` 0) or last half of a pair of which the lesser length is ``m``."""
    half = m // 2
    h = T.span_hash(code, s, s + half) if side == 0 else T.span_hash(code, e - (m - half), e)
    return T.mix(h ^ T.mix((leaf.astype(np.uint64) * np.uint64(4) + np.uint64(2 * side + shorter)) * _GOLD + _GOLD))


def one_edit(code: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` differ by exactly one insertion, deletion or replacement."""
    la, lb = e[a] - s[a], e[b] - s[b]
    m = np.minimum(la, lb)
    first = np.cumsum(m) - m
    off = np.arange(int(m.sum())) - np.repeat(first, m)
    left = code[np.repeat(s[a], m) + off] != code[np.repeat(s[b], m) + off]
    right = code[np.repeat(e[a] - m, m) + off] != code[np.repeat(e[b] - m, m) + off]
    size = np.repeat(m, m)
    prefix = np.minimum.reduceat(np.where(left, off, size), first)  # equal letters at the front
    suffix = np.minimum.reduceat(np.where(right, size - 1 - off, size), first)  # and at the back
    wrong = np.add.reduceat(left, first)
    return np.where(la == lb, wrong == 1, (np.abs(la - lb) == 1) & (prefix + suffix >= m))


def near_pairs(key: np.ndarray, taken: np.ndarray, code: np.ndarray, s: np.ndarray, e: np.ndarray, depth: int):
    """``(a, b)`` arrays of row pairs that are near, both ways, for the rows of whole subtries."""
    size, low = e - s, vectors(code, s, e)[:, depth:]
    _, bucket = np.unique(key, return_inverse=True)
    wide = int(size.max()) + 2
    roots, root = np.unique(bucket * wide + size, return_inverse=True)

    def start(q, longer):  # the root of the words in the query's subtrie that are so much longer
        want = bucket[q] * wide + size[q] + longer
        to = np.minimum(np.searchsorted(roots, want), len(roots) - 1)
        hit = roots[to] == want
        return q[hit], to[hit]

    full, less = np.flatnonzero(taken == NONE), np.flatnonzero(taken != NONE)
    # (queries, targets, how much longer the target is, surplus and deficit left below, found from one side only)
    plans = [(full, full, 0, 1, 1, False), (full, full, 1, 1, 0, False), (full, full, -1, 0, 1, False),
             (less, full, 0, 1, 0, True), (less, full, -1, 0, 0, True), (less, less, 0, 0, 0, False)]
    tries: dict[bool, Trie] = {}
    for queries, targets, longer, surplus, deficit, one_side in plans:
        if not len(queries) or not len(targets):
            continue
        if (targets is full) not in tries:
            tries[targets is full] = Trie(targets, root, low, code, s, e)
        trie = tries[targets is full]
        for i in range(0, len(queries), QUERIES):
            q, node = start(queries[i: i + QUERIES], longer)
            budget = np.ones(len(q), np.int8)
            for q, leaf in trie.search(q, node, budget * surplus, budget * deficit, low):
                m = size[q] + min(longer, 0)
                for side in (0, 1):
                    want = half_keys(leaf, side, int(longer > 0), m, code, s[q], e[q])
                    lo, hi = np.searchsorted(trie.keys, want), np.searchsorted(trie.keys, want, side="right")
                    n = hi - lo
                    ends = np.cumsum(n)
                    for j in np.split(np.arange(len(q)), np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS))):
                        a = np.repeat(q[j], n[j])
                        b = trie.at[np.repeat(lo[j] - (np.cumsum(n[j]) - n[j]), n[j]) + np.arange(len(a))]
                        ok = a != b
                        if targets is less:
                            ok &= taken[a] != taken[b]
                        a, b = a[ok], b[ok]
                        if not len(a):
                            continue
                        ok = one_edit(code, s, e, a, b)
                        a, b = a[ok], b[ok]
                        if side and len(a):  # already found by the first half
                            half = (size[a] + min(longer, 0)) // 2
                            ok = T.span_hash(code, s[a], s[a] + half) != T.span_hash(code, s[b], s[b] + half)
                            a, b = a[ok], b[ok]
                        yield a, b
                        if one_side:
                            yield b, a


def _search(depth: int):
    """Rows come subtrie by subtrie; blocks of whole subtries give each word's number of near
    words there and the best of them."""
    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        code, s, e = latin(block["word"])
        n, word = block["n"].to_numpy(), block["word"].combine_chunks()
        for a, b in near_pairs(block["key"].to_numpy(), block["taken"].to_numpy(), code, s, e, depth):
            if not len(a):
                continue
            t = pa.table({"a": pa.array(a), "n": pa.array(n[b]), "w": word.take(pa.array(b))})
            t = t.sort_by([("a", "ascending"), ("n", "descending"), ("w", "ascending")])
            own, at, many = np.unique(t["a"].to_numpy(), return_index=True, return_counts=True)
            best = t.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([word.take(pa.array(own)), pa.array(many.astype(np.int64)), best["n"].combine_chunks(), best["w"].combine_chunks()],
                                             names=["word", "near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.Table] = []
        for batch in batches:
            wait.append(pa.Table.from_batches([batch]))
            if sum(len(t) for t in wait) >= BLOCK_ROWS:
                table = pa.concat_tables(wait).combine_chunks()
                key = table["key"].to_numpy()
                last = int(np.argmax(key == key[-1]))  # the last subtrie may go on
                if last:
                    yield from found(table.slice(0, last).combine_chunks())
                wait = [table.slice(last).combine_chunks()]
        if wait and (table := pa.concat_tables(wait).combine_chunks()).num_rows:
            yield from found(table)
    return run


KEYS = "subtrie long, key long, taken int, word string, n long"
FOUND = "word string, near long, best_n long, best string"


def near_words(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words of ``(word, n)`` that have a near word.
    ``words`` must give the same rows when read again."""
    def searched(rows: DataFrame, depth: int) -> DataFrame:
        return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_search(depth), FOUND)

    rows = words.select("word", "n").mapInArrow(_keys(DEPTH), KEYS)
    hot = stored(rows.groupBy("subtrie").count().where(F.col("count") > hot_rows).select("subtrie"))
    if hot.isEmpty():
        got = searched(rows, DEPTH)
    else:
        deep = words.select("word", "n").mapInArrow(_keys(LEVELS), KEYS).join(hot, "subtrie", "left_semi")
        got = searched(rows.join(hot, "subtrie", "left_anti"), DEPTH).unionByName(searched(deep.select(*KEYS_ORDER), LEVELS))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    got = got.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x"))
    return got.select("word", "n_near", F.col("x.w").alias("best"), (-F.col("x.m")).alias("best_n"))


KEYS_ORDER = ["subtrie", "key", "taken", "word", "n"]


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: where the forms lead, by doubling the steps.  Counts
    grow along the forms, so they never come back."""
    cur = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = cur.select(F.col("word").alias("w"), F.col("root").alias("r"))
        nxt = cur.join(ahead, F.col("root") == F.col("w"), "left")
        nxt = stored(nxt.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        cur = nxt.drop("moved")
        if not nxt.where("moved").limit(1).count():
            return cur


def spelling_groups(docs: DataFrame, slip: int = 0, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO,
                    hot_rows: int = HOT_ROWS, **columns: str) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``."""
    words = stored(word_counts(docs, slip, min_letters, min_count, **columns))
    x = words.join(near_words(words, hot_rows), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    x = stored(x.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")))
    x = x.join(roots(x.where("form is not null")), "word", "left")
    return x.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
