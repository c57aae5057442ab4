"""Harmonic packing: exact round trips, full bins, no padding."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propkit.llm import harmonic, queries
from propkit.llm.queries import tokenizer_path
from tests.llm.conftest import odd_rows


def power(n):
    return n > 0 and n & (n - 1) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=20))
def test_cuts_are_whole(sizes):
    doc, start, length = harmonic.cuts(np.array(sizes), 64)
    for i, n in enumerate(sizes):
        mine = list(zip(start[doc == i].tolist(), length[doc == i].tolist()))
        assert [s for s, _ in mine] == [sum(m for _, m in mine[:j]) for j in range(len(mine))]
        assert sum(m for _, m in mine) == n and all(power(m) for _, m in mine)
        assert len(mine) == n // 64 + bin(n % 64).count("1")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 4, 8, 16, 32, 64]), max_size=200))
def test_bins_hold_a_fixed_count(lengths):
    lengths = np.array(lengths, np.int64)
    order, nth, place = harmonic.full_bins(lengths, 64)
    left = np.setdiff1d(np.arange(len(lengths)), order)
    for b in range(int(nth[-1]) + 1 if len(nth) else 0):
        mine = lengths[order[nth == b]]
        assert len(set(mine.tolist())) == 1 and len(mine) == 64 // mine[0] and place[nth == b].tolist() == list(range(len(mine)))
    for n, many in collections.Counter(lengths[left].tolist()).items():
        assert many < 64 // n
    order, nth, place = harmonic.last_bins(lengths[left], 64)
    assert sorted(order.tolist()) == list(range(len(left)))
    for b in set(nth.tolist()):
        mine = lengths[left][order[nth == b]]
        assert len(set(mine.tolist())) == 1 and power(len(mine)) and place[nth == b].tolist() == list(range(len(mine)))


def check(pieces, texts, capacity=2048, end=1):
    """Every id once, bins gapless and without padding."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    want = collections.Counter()
    for d, t in texts:
        want[(str(d), np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes())] += 1
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs[(str(r.doc_id), r.doc_tokens)].append((r.start, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    for (d, n), parts in docs.items():  # repeated ids: each start as often as the document
        whole = [w for (e, w), many in want.items() for _ in range(many) if e == d and len(w) == 4 * n]
        assert collections.Counter(p for p in parts) == collections.Counter(
            (s, w[4 * s: 4 * s + len(b)]) for w in whole for s, b in {(s, b"x" * len(b)) for s, b in parts})
        assert sum(len(b) for _, b in parts) == 4 * n * len(whole)
    assert sum(n for _, n in docs) and {(d, n) for d, n in docs} == {(d, len(w) // 4) for d, w in want}
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity and power(end)


def test_packed_documents(odd, none):
    rows = [(d, t) for d, t, *_ in odd_rows()]
    check(harmonic.pack_documents(odd, tokenizer_path()).collect(), rows)
    check(harmonic.pack_documents(odd.repartition(5), tokenizer_path(), capacity=64).collect(), rows, 64)
    assert harmonic.pack_documents(none, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        harmonic.pack_documents(odd, tokenizer_path(), capacity=1000)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = harmonic.pack_documents(docs, tokenizer_path()).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    cols = queries.op13_harmonic_packing(spark, "/root/testdata/sf0.001").columns
    assert cols == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_sequences(odd):
    pieces = harmonic.pack_documents(odd, tokenizer_path()).cache()
    got = harmonic.sequences(pieces).collect()
    assert sum(r.tokens for r in got) == sum(r.length for r in pieces.collect())
    for r in got:
        assert len(r.ids) == 4 * r.tokens and power(r.tokens)
    pieces.unpersist()
