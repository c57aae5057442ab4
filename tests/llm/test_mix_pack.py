"""Mixing and packing: exact shares, round trips and bounds."""

import collections
import functools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propkit.llm import _text as T
from propkit.llm import _tokens, mixing, packing
from propkit.llm.queries import tokenizer_path
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_mix(odd, none):
    got = mixing.mix(odd).collect()
    rows = [(d, len(re.findall(r"[^ \t-\r]+", t or "")), s) for d, t, _, s, *_ in odd_rows()]
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), n) for d, n, _ in rows)
    total = collections.Counter()
    for _, n, s in rows:
        total[s] += n
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == total[r.source]
        taken[r.source] += r.taken
    for r in got:
        assert taken[r.source] == min(int(r.target + 0.5), 2 * r.source_size)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(total.values())) < 1e-6
    again = mixing.mix(odd.repartition(3)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(again) == key(got)
    assert mixing.mix(none).count() == 0


def test_mixed_rows(odd, none):
    out = mixing.mixed_documents(odd, block_words=64)
    assert out.schema == odd.schema
    n = sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in out.collect())
    assert n == sum(r.taken for r in mixing.mix(odd, block_words=64).collect())
    assert mixing.mixed_documents(none).count() == 0


def test_pieces_follow_the_schedule(spark):
    """Each slot holds one block of one source, and every stretch of slots nearly the shares."""
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 90))), rng.choice("aabbbc")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.Mix(docs, block_words=32)
    source = {r["row"]: (r.source, r.target) for r in m.tape.collect()}
    slots = collections.defaultdict(list)
    for r in m.pieces.collect():
        slots[r.slot].append((source[r["row"]][0], r.part))
    target = dict(source.values())
    seen, total, done = collections.Counter(), sum(target.values()), 0
    for slot in sorted(slots):
        (name,) = {s for s, _ in slots[slot]}
        words = sum(p for _, p in slots[slot])
        assert words <= 32
        seen[name] += words
        done += words
        assert all(abs(seen[k] - done * t / total) < 32 * 5 for k, t in target.items())
    assert all(abs(seen[k] - t) <= 1 for k, t in target.items())
    out = mixing.mixed_documents(docs, block_words=32, slot_col="at").collect()
    assert {r.at for r in out} <= set(slots) and sum(len(r.text.split()) for r in out) == done


def test_repeated_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "en"), (1, "a b c", "x", "de"), (1, "a b c", "x", "de")], "doc_id long, text string, source string, lang string")
    got = collections.Counter(r.lang for r in mixing.mixed_documents(docs).collect() if r.text == "a b c")
    assert set(got) == {"en", "de"}


def test_schedule_is_even(spark):
    src = spark.createDataFrame([(0, 3000), (1, 1000), (2, 2000), (3, 0), (4, 7)], "src long, words long")
    got = sorted((r.slot, r["src"], r["rank"]) for r in mixing.schedule(src, 6007, 10).collect() if r.slot < 601)
    seen = collections.Counter()
    for i, (_, s, rank) in enumerate(got, 1):
        assert rank == seen[s]
        seen[s] += 1
        assert all(abs(seen[k] - i * w / 6007) < 4 for k, w in ((0, 3000), (1, 1000), (2, 2000)))


ODD_TEXTS = ["", "  a  b\n\n c\n", "it's  don't\tx\r\ny 'tis o'clock", "é é\u0085é \n\n x　y  z", "<|endoftext|> 12 ab12", "a\n b", "日本 語\n。 ok",
             " lead", "tail ", "\n", "😀 hi\n\n\n there,friend", "x×y ÷,z", "\x1c a\x00b"]


def encoded(texts):
    tok, out = _tokens.ChunkTokenizer(tokenizer_path()), []
    for _, buf, ends in T.blocks(pa.array(texts, pa.string())):
        ids, bounds = tok.encode(buf, ends, 2)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_ids_are_the_tokenizers(tokenizer):
    want = [e.ids + [2] for e in tokenizer.encode_batch(ODD_TEXTS, add_special_tokens=False)]
    assert encoded(ODD_TEXTS) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'st.,!12 \n\t\r  \u0085é×ß日\U0001F600")), max_size=40))
def test_ids_of_any_text(text):
    tok, whole = _tokens.tokenizer(tokenizer_path()), _whole()
    (_, buf, ends), = T.blocks(pa.array([text]))
    assert tok.encode(buf, ends, 2)[0].tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


@functools.cache
def _whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def twins(size):
    """Two texts of ``size`` letters that a polynomial hash modulo a power of two cannot tell apart."""
    a = "a"
    while len(a) < size:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_different_texts_have_different_hashes(tokenizer):
    texts = [*twins(1024), *twins(2048), "x" * 9, "x" * 9 + "\0", "", "\0"]
    (_, buf, ends), = T.blocks(pa.array(texts))
    starts = np.concatenate(([0], ends[:-1] + 1))
    assert len(set(T.span_hash(buf, starts, ends).tolist())) == len(texts)
    part = T.span_hash(buf, starts[:1] + 3, starts[:1] + 90)  # the hash does not depend on the place
    assert part == T.span_hash(buf[3:].copy(), starts[:1], starts[:1] + 87)
    assert encoded(texts) == [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_equal_hashes_do_not_share_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "span_hash", lambda buf, s, e: np.full(len(s), 7, np.uint64))
    texts = ["one two three", "four, five", "one two three"]
    assert encoded(texts) == [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_plan(counts, capacity):
    packed = packing.plan(counts, capacity)
    used = collections.Counter()
    for fill, bins in packed:
        assert sum(s * n for s, n in fill.items()) <= capacity and bins > 0
        for s, n in fill.items():
            used[s] += n * bins
    assert used == collections.Counter({s: n for s, n in counts.items() if n})
    return sum(b for _, b in packed)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=6))
def test_plan_against_bounds(counts):
    bins = check_plan(counts, 40)
    assert packing.lower_bound(counts, 40) <= bins <= sum(b for _, b in packing.best_fit(counts, 40))


def test_completion_beats_best_fit():
    counts = {44: 1, 24: 2, 22: 2, 21: 1, 17: 2, 8: 2, 6: 2}  # best-fit decreasing takes a bin more
    assert sum(b for _, b in packing.best_fit(counts, 61)) >= check_plan(counts, 61) >= packing.lower_bound(counts, 61)
    halves = {6: 4, 7: 4, 4: 4, 3: 4}
    assert check_plan(halves, 10) == packing.lower_bound(halves, 10) == 8


def test_many_short_pieces_fill_bins():
    """Bins of four to eight pieces, where best fit leaves gaps: near the bound."""
    rng = random.Random(3)
    for sizes, most in (([205, 206, 210, 230, 199, 180], 4167), ([151, 163, 178, 190, 214, 237, 258], 3904), (range(140, 250, 11), 3749), (range(100, 200, 5), 2908)):
        counts = collections.Counter(rng.choice(list(sizes)) for _ in range(20000))
        assert check_plan(counts, 1024) <= most


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 20), st.sampled_from(packing.ORDERS))
def test_fillings_are_the_undominated_ones(counts, room, order):
    def every(sizes, room):
        if not sizes:
            yield {}
            return
        s, *rest = sizes
        for n in range(min(counts[s], room // s) + 1):
            for f in every(rest, room - n * s):
                yield f | {s: n} if n else f
    whole = [f for f in every(sorted(counts), room)]
    got = list(packing.fillings(room, counts, order))
    free = [room - sum(s * n for s, n in f.items()) for f in got]
    assert free == sorted(free) and all(f in whole for f in got)
    few = [f for f in whole if sum(f.values()) <= packing.COMPARED]
    best = [f for f in few if not any(f != g and packing.dominated(f, g) for g in few)]
    assert all(f in got for f in best)  # and nothing that another one dominates
    for f in got:
        if sum(f.values()) <= packing.COMPARED:
            assert f in best or not any(packing.dominated(f, g) for g in got if g != f and sum(g.values()) <= packing.COMPARED)


def test_packed_pieces(spark, odd, none, tokenizer):
    got = packing.pack_documents(odd, tokenizer_path(), with_ids=True).collect()
    text = {}
    want = collections.Counter()
    for d, t, *_ in odd_rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want[(str(d), i, a, b - a, zlib.crc32(raw), raw)] += 1
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    for r in got:
        text.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in text.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_random_lengths_are_near_the_bound():
    rng = random.Random(1)
    counts = collections.Counter(rng.randint(1, 1024) for _ in range(3000))
    assert check_plan(counts, 1024) <= 1.01 * packing.lower_bound(counts, 1024)


def test_tokenising_holds_little_of_a_batch():
    """What a worker holds does not grow with the Arrow batch (it runs beside others in an executor)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from propkit.llm import packing
    from propkit.llm.queries import tokenizer_path
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(2000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 2000, 600)) for _ in range(2400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    run = packing._pieces(tokenizer_path(), 1024, False)
    list(run(iter([batch.slice(0, 5)])))  # the tokenizer itself
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts) and peak < 64 << 20


def test_a_workers_cache_is_small():
    tok, held = _tokens.ChunkTokenizer(tokenizer_path()), []
    for k in range(4):
        text = " ".join(f"{i:x}q" for i in range(k * 150_000, (k + 1) * 150_000)).encode()
        buf, ends = np.frombuffer(text + b"\n", np.uint8), np.array([len(text)])
        ids, bounds = tok.encode(buf, ends, 2)
        assert tok.enc.decode_bytes(ids[:-1].tolist()) == text and bounds.tolist() == [0, len(ids)]
        held.append(sum(x.nbytes for x in (tok.table, tok.entry, tok.first, tok.count, tok.flat, tok.raw, tok.at, tok.size)))
    assert max(held) < 48 << 20
