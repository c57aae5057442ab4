"""Spelling variants against brute force over all pairs, hot subtries and odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from propkit.llm import spelling
from tests.llm.conftest import SCHEMA


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def want(rows, slip, min_letters=7, min_count=2, ratio=10):
    count = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= min_letters
    count = {w: n for w, n in count.items() if n >= min_count}
    by, out = collections.defaultdict(list), {}
    for w in count:
        by[len(w)].append(w)
    form, many = {}, {}
    for w, n in count.items():
        close = [x for k in (-1, 0, 1) for x in by[len(w) + k] if near(w, x)]
        best = min(close, key=lambda x: (-count[x], x), default=None)
        many[w], form[w] = len(close), best if best and count[best] >= ratio * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, many[w], count.get(form[w]))
    return out


def got(docs, **how):
    rows = spelling.spelling_groups(docs, **how).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("etaonirh") for _ in range(rng.randint(7, 12))) for _ in range(60)] + ["ÀÉîöühñx", "straßeßen", "e" * 20, "e" * 21, "x" * 90]
    rows = []
    for d in range(300):
        words = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(w)), rng.choice("etaoxé")
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w.upper() if w.isascii() else w])
            words.append(w)
        words += ["zabcdefg"] * 3 + ["zabcdefx"] * (d % 10 == 3) + ["zabcdeyx"] * (d in (7, 9))  # a chain of forms
        rows.append((d if d % 50 else None, rng.choice([" ", ", ", "一", "1"]).join(words) if d % 40 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 1, 2, "x", "y") for d, t in rows], SCHEMA)


def test_against_all_pairs(spark):
    rows = corpus()
    docs = frame(spark, rows).repartition(6)
    expected = want(rows, 31)
    assert expected["zabcdeyx"][:2] == ("zabcdefx", "zabcdefg")
    assert sum(x[0] is not None for x in expected.values()) > 50 and len(expected) > 500
    assert got(docs, slip=31) == expected
    assert got(docs, slip=31, hot_rows=20) == expected  # subtries cut further down
    assert got(docs) == want(rows, 0)


def test_odd_and_no_rows(odd, none):
    from tests.llm.conftest import odd_rows
    assert got(odd, slip=31, min_count=1) == want([r[:2] for r in odd_rows()], 31, min_count=1)
    assert got(none, slip=31) == {}


def test_crc_goes_on():
    words = [b"", b"a", b"word", b"long" * 40, "é".encode()]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    out = spelling.crc_after(start, buf, np.concatenate(([0], ends[:-1])), ends)
    assert out.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=9), st.text("abé", min_size=1, max_size=9))
def test_one_edit(a, b):
    code, s, e = spelling.latin(pa.array([a, b]))
    assert spelling.one_edit(code, s, e, np.array([0]), np.array([1]))[0] == near(a, b)
