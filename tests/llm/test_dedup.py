"""Exact and near duplicates, shards and passages against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from propkit.llm import exact_dedup, near_dedup, passages, sharding
from propkit.llm._spark import Table, components
from tests.llm.conftest import odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return sorted(out, key=str)


def test_near_groups_of_odd_rows(odd, none):
    want = brute_components([r[:2] for r in odd_rows()], 2)
    got = sorted([tuple(r) for r in near_dedup.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    assert got == want
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_chains_are_whole(spark):
    """Documents that are linked only through others, in one large group."""
    rng = random.Random(5)
    w = words(rng, 200).split()
    rows = []
    for i in range(60):
        if i % 3 == 0:
            w = list(w)
            for k in rng.sample(range(200), 8):
                w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w) + f" t{i}"))
    rows += [(100 + i, words(rng, 50)) for i in range(20)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([(r[0], r[1], r[2]) for r in got.select("doc_id", "n_shingles", "component_id").collect()], key=str) == brute_components(rows, 2)


def test_one_of_each_near_group_stays(odd, none):
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.schema == odd.schema
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert "1" in ids and not {"2", "3", "4", "8", "17"} & set(ids) and ids.count("10") == 2 and ids.count("11") == 1
    assert near_dedup.drop_near_duplicates(none).count() == 0


def test_odd_sketch(spark):
    rng = np.random.default_rng(4)
    for n in (50, 500, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b = a.copy()
        b[: int(n / 9.5)] = rng.integers(0, 2**63, int(n / 9.5), dtype=np.uint64)  # just linked
        x = near_dedup.odd_sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        diff = int(np.bitwise_count((x[0] ^ x[1]).view(np.uint64)).sum())
        limit = spark.range(1).select(near_dedup.odd_limit(F.lit(n), F.lit(n), 80)).first()[0]
        assert diff <= limit < 1.25 * diff + 15


def test_joint_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 1.0):
        both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, 1000 - len(both), dtype=np.uint64)])) for _ in range(2)]
        g, bounds = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        k = near_dedup.registers(g, bounds)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        est = near_dedup.joint_estimate(k[:1], k[1:], np.array([len(sets[0])], float), np.array([len(sets[1])], float))[0]
        assert abs(est - true) < 0.15
        merged = near_dedup.registers(np.union1d(*sets), np.array([0, len(np.union1d(*sets))]))
        assert (merged[0] == np.maximum(k[0], k[1])).all()  # registers of a union


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(odd, none, weak):
    chunk_hash = (lambda c: F.pmod(F.xxhash64(c), F.lit(2))) if weak else F.xxhash64  # identifiers that collide
    got = exact_dedup.exact_groups(odd, chunk_hash=chunk_hash).collect()
    rows = [(d, (t or "").translate(LOWER)) for d, t, *_ in odd_rows()]
    assert len(got) == len(rows)
    for r in got:
        same = [t for t in {t for d, t in rows if d == r.doc_id} if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert len(same) == 1
        ids = [d for d, t in rows if t == same[0]]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_rows_that_stay(odd, none):
    kept = exact_dedup.drop_exact_duplicates(odd)
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert kept.schema == odd.schema and len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in odd_rows()})
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 9, 1000])
def test_jump_hash(spark, shards):
    keys = [*range(-20, 200), 2**62, -2**63, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {k: jump(k, shards) for k in keys}


def test_shards(odd, none):
    got = sharding.assign_shards(odd, 3).collect()
    assert len(got) == len(odd_rows())
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert sharding.assign_shards(none).count() == 0


def test_passages(spark, odd, none):
    rng = random.Random(9)
    passage = words(rng, 70).split()
    rows = []
    for i in range(12):
        p = list(passage)
        if i % 3 == 1:
            p[35] = f"edit{i}"
        if i % 3 == 2:
            del p[20]
        rows.append((i, words(rng, 40 + i) + " " + " ".join(p) + " " + words(rng, 30)))
    rows += [(50 + i, words(rng, 200)) for i in range(10)] + [(70, rows[0][1]), (71, words(rng, 49)), (72, None)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {*range(12), 70}
    for r in got:
        if not r.copy and r.doc_id < 12:
            lo = 40 + r.doc_id
            assert abs(r.start_word - lo) <= 4 and abs(r.stop_word - lo - 70) <= 4
    assert passages.repeated_passages(none).count() == 0
    assert {(r.doc_id, r.other_id) for r in passages.repeated_passages(odd).collect()} >= {(2, 1), (3, 1), (4, 1)}


def test_every_shared_window_is_in_a_passage(spark):
    rng = random.Random(21)
    shared, early = words(rng, 60).split(), words(rng, 70).split()
    around = lambda w, n=40: " ".join([words(rng, n), *w, words(rng, n)])
    # parts of the passage stand in earlier texts; its seeds have several first holders
    texts = [around(shared[:18]), around(shared[14:34]), around(shared[30:48]), around(shared[42:]), around(shared), around(shared)]
    texts += [around(["de"] * 120), around(["DE"] * 70), " ".join(["de"] * 300), " ".join(["der", "die", "das"] * 40), around(["der", "die", "das"] * 30)]
    texts += [around(early + words(rng, 30).split() + early), around(early), around(early + early)]
    rows = [*enumerate(texts), (5, texts[5]), (6, texts[6]), (40, texts[8]), (None, around(shared)), (41, words(rng, 200))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    held, split = {}, {i: re.findall(r"[^ \t-\r]+", t.translate(LOWER)) for i, t in rows}
    for i, w in split.items():
        for p in range(len(w) - 49):
            held.setdefault(tuple(w[p: p + 50]), set()).add(i)
    for i, w in split.items():
        own = [(r.start_word, r.stop_word) for r in got if r.doc_id == i]
        for p in range(len(w) - 49):
            others = {tuple(split[j]) for j in held[tuple(w[p: p + 50])]} - {tuple(w)}
            assert not others or any(a <= p and p + 50 <= b for a, b in own) or i == 40, (i, p)  # 40 is a whole copy of 8
    for r in got:
        if r.matched_words == r.stop_word - r.start_word == r.other_stop - r.other_start and not r.copy:
            assert split[r.doc_id][r.start_word: r.stop_word] == split[r.other_id][r.other_start: r.other_stop]


def test_edited_passages_whose_seeds_others_hold_first(spark):
    rng = random.Random(31)
    shared = words(rng, 90).split()
    edited = lambda first: [words(rng, 1) + "zz" if i % 30 == first else w for i, w in enumerate(shared)]
    around = lambda w: " ".join([words(rng, 45), *w, words(rng, 45)])
    # earlier texts hold pieces that are too short for a passage, and so are the first holders of all seeds
    texts = [around(shared[i: i + 28]) for i in range(0, 90, 14)] + [around(edited(f)) for f in (9, 19, 29)]
    got = passages.repeated_passages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    full = len(texts) - 3
    group, links = {full}, {(r.doc_id, r.other_id) for r in got}
    for _ in range(3):
        group |= {b for a, b in links if a in group}
    assert group == {full, full + 1, full + 2} and {a for a, _ in links} == group


def test_chaining_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 25
        x, y = rng.integers(0, 120, n), rng.integers(0, 120, n)
        best = [0.0] * n
        order = np.lexsort((y, x))
        for a, i in enumerate(order):
            best[i] = passages.SEED_GAIN
            top, at = 0.0, None
            for j in order[:a]:
                if x[j] < x[i] and y[j] < y[i]:
                    v = best[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j])
                    if v > top:
                        top, at = v, j
            if at is not None and x[i] - x[at] <= passages.MOST_GAP and y[i] - y[at] <= passages.MOST_GAP:
                best[i] = passages.SEED_GAIN + top
        c = passages.chains(x, y)
        assert sorted(np.concatenate(c).tolist()) == list(range(n))
        d = c[0]
        value = passages.SEED_GAIN * len(d) - passages.GAP_COST * (x[d[-1]] - x[d[0]] + y[d[-1]] - y[d[0]])
        assert abs(value - max(best)) < 1e-9 and (np.diff(x[d]) > 0).all() and (np.diff(y[d]) > 0).all()


def test_chains_of_many_pairs():
    rng = np.random.default_rng(6)
    x, y, bounds = [], [], [0]
    for i in range(400):
        at = sorted({(int(p), int(q)) for p, q in rng.integers(0, (20, 100, 900)[i % 3], (int(rng.integers(1, 30)), 2))})
        if i % 2:  # one diagonal, and a turn
            step = np.cumsum(rng.integers(1, 40, len(at)))
            at = [(int(p), int(p) + 3 * (j > 4)) for j, p in enumerate(step)]
        x += [p for p, _ in at]
        y += [q for _, q in at]
        bounds.append(len(x))
    x, y = np.array(x), np.array(y)
    label = passages.all_chains(x, y, np.array(bounds))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        got = {tuple(np.flatnonzero(label[lo:hi] == k)) for k in label[lo:hi]}
        assert got == {tuple(c) for c in passages.chains(x[lo:hi], y[lo:hi])}


def plain_reach(same):
    top, total, best = 0, 0, 0
    for i, v in enumerate(same):
        total += 1 if v else -2
        if total > top:
            top, best = total, i + 1
    return best, sum(same[:best])


def plain_align(a, b, x, y):
    matched = 0
    for p, q, r, s in zip(x[:-1], x[1:], y[:-1], y[1:]):
        if q - p == s - r:
            matched += sum(u == v for u, v in zip(a[p:q], b[r:s]))
            continue
        row = [0] * (s - r + 1)
        for u in a[p:q]:
            new = [0]
            for j, v in enumerate(b[r:s]):
                new.append(max(row[j + 1], new[j], row[j] + (u == v)))
            row = new
        matched += row[-1]
    n = min(x[0], y[0], passages.EXTEND)
    left, m = plain_reach([a[x[0] - i] == b[y[0] - i] for i in range(1, n + 1)])
    n = min(len(a) - x[-1], len(b) - y[-1], passages.EXTEND + passages.SEED)
    right, k = plain_reach([a[x[-1] + i] == b[y[-1] + i] for i in range(n)])
    return x[0] - left, x[-1] + right, y[0] - left, y[-1] + right, matched + m + k


def test_alignment_of_many_chains():
    rng = np.random.default_rng(8)
    sides, bounds, xs, ys, ends, want = ([], []), ([0], [0]), [], [], [0], []
    for i in range(200):
        a = rng.integers(1, (3, 6, 400)[i % 3], int(rng.integers(40, 300))).tolist()
        b = list(a)
        for k in rng.integers(0, 30, int(rng.integers(0, 5))).tolist():
            b[k: k + k % 4] = rng.integers(1, 9, k % 5).tolist()
        top = min(len(a), len(b)) - passages.SEED
        x = sorted({int(v) for v in rng.integers(0, min(top, 60), 6)})
        y = sorted({int(v) for v in rng.integers(0, min(top, 60), 6)}) if i % 2 else x
        x, y = x[: min(len(x), len(y))], y[: min(len(x), len(y))]
        want.append(plain_align(a, b, x, y))
        for side, bound, w in zip(sides, bounds, (a, b)):
            side += w
            bound.append(len(side))
        xs += x
        ys += y
        ends.append(len(xs))
    got = passages.align_all(*(np.array(v, t) for side, bound in zip(sides, bounds) for v, t in ((side, np.uint64), (bound, np.int64))),
                             np.array(xs), np.array(ys), np.array(ends))
    assert [tuple(c) for c in got.T.tolist()] == want


def test_a_repeated_word_alone_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(41)
    around = lambda w: " ".join([words(rng, 70), *w, words(rng, 70)])
    after = words(rng, 45).split()
    edited = lambda first: [words(rng, 1) + "zz" if i % 12 == first else w for i, w in enumerate(after)]
    texts = [around(["of"] * (24 + i % 8)) for i in range(30)] + [around(["of"] * 30 + edited(f)) for f in (5, 9)]
    sought = []
    seek = passages.pair_matches
    monkeypatch.setattr(passages, "pair_matches", lambda held, pairs: sought.extend(pairs.collect()) or seek(held, pairs))
    got = passages.repeated_passages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(30, 31), (31, 30)}
    assert 0 < len(sought) < 30


def test_many_copies_of_a_passage_make_few_pairs(spark, monkeypatch):
    """Edited copies whose seeds a short piece holds first are linked through one of them, not with each other."""
    rng = random.Random(43)
    shared = words(rng, 90).split()
    around = lambda w: " ".join([words(rng, 45), *w, words(rng, 45)])
    texts = [around(shared[i: i + 28]) for i in range(0, 90, 14)]
    full = len(texts)
    texts += [around([f"e{k}x{i}" if i == 5 + 4 * k else w for i, w in enumerate(shared)]) for k in range(16)]
    sought = []
    seek = passages.pair_matches
    monkeypatch.setattr(passages, "pair_matches", lambda held, pairs: sought.extend(pairs.collect()) or seek(held, pairs))
    got = passages.repeated_passages(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    group, links = {full}, {(r.doc_id, r.other_id) for r in got}
    for _ in range(3):
        group |= {b for a, b in links if a in group}
    assert group == {*range(full, full + 16)}
    assert 0 < sum(r.b >= full for r in sought) < 60  # of 120


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f and f.endswith(".data")}
    was = data()
    table = Table(spark.range(20000, numPartitions=4).groupBy((F.col("id") % 7000).alias("k")).count())
    until = time.time() + 20
    while data() - was and time.time() < until:
        time.sleep(0.2)
    assert not data() - was and table.rows.count() == 7000
