"""Conversation repair against brute force, chunk borders and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from propkit.llm import conversations as C
from propkit.llm import queries

SPACES = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired rows): every edit string with up to four insertions."""
    kinds, best = faults(rows), None

    def go(i, letters, cost, audit, made, free):
        nonlocal best
        if best and cost > best[0]:
            return
        if not re.fullmatch("s?(ua)*u?", letters):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", letters):
                best = min([b for b in (best, (cost, audit, made)) if b], key=lambda b: b[:2])
        else:
            (role, text), kind = rows[i], kinds[i]
            go(i + 1, letters, cost + 3, audit + "D", made, free)
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, letters + role[0], cost + late, audit + "K", [*made, f"{role}:{text}"], free)
                for to in ("user", "assistant"):
                    go(i + 1, letters + to[0], cost + 2 + late, audit + "R", [*made, f"{to}:{text}"], free)
        if free:
            for to in ("user", "assistant"):
                go(i, letters + to[0], cost + 2, audit + "I", [*made, f"{to}:"], free - 1)

    go(0, "", 0, "", [], 4)
    return best


def want(conv, rows):
    """The digest of one conversation of ``(turn, role, text)`` in order."""
    pairs = [(r, t) for _, r, t in rows]
    kinds, turns = faults(pairs), {t for t, *_ in rows if t is not None}
    cost, audit, made = brute(pairs)
    roles = [r[:1] for r, _ in pairs]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            out += [(c, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def sample(n, seed=1):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"]
    texts = ["Hi.", "Yes", "ok!  ", "", " \n", None, "why?", "é…", "long text here."]
    return [(c if c else None, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts))
            for c in range(n) for t in rng.sample(range(9), rng.randint(1, 4))]


SCHEMA = "conv_id long, turn long, role string, text string, edits string, kind int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA)


@pytest.mark.parametrize("harm", [False, True])
def test_against_brute_force(spark, harm):
    rows = sample(150)
    got = (C.damage_and_repair if harm else C.repair)(frame(spark, rows).repartition(7)).collect()
    left = damaged(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    expected = {want(c, ordered([r[1:] for r in left if r[0] == c])) for c in {r[0] for r in rows}}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_a_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.damage_and_repair(frame(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(frame(spark, [])).count() == C.repaired_rows(frame(spark, [])).count() == 0


def test_repaired_rows_are_what_is_hashed(spark):
    rows = frame(spark, sample(60, 2))
    digest = {r.conv_id: r for r in C.repair(rows).collect()}
    made = sorted(C.repaired_rows(rows).collect(), key=lambda r: (str(r.conv_id), r.place))
    for c, part in itertools.groupby(made, lambda r: r.conv_id):
        part = list(part)
        assert "".join(r.edit for r in part) == digest[c].audit
        text = "\n".join(f"{r.role}:{r.text}" for r in part if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == digest[c].repaired_sha256


def test_chunks_do_not_change_the_edits(monkeypatch):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for p in range(rng.randint(1, 40), 0, -1):
            live = rng.random() < 0.8
            rows.append((c, p, rng.choice(["system", "user", "assistant", "tool"]), b"%d" % p, live, rng.random() < 0.3, 0 if live else rng.randint(1, 3), False))
    names = ["c", "t", "r", "h", "l", "u", "d", "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    schema = pa.schema([(n, t) for n, t in zip(["c", "t", "r", "h", "e", "l", "u", "d", "b"], [
        pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()])])

    def audits(chunk):
        monkeypatch.setattr(C, "CHUNK", chunk)
        C.agenda.cache_clear()
        out = [r for b in C._backward(schema)(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns])]
        found = {}
        for c, part in itertools.groupby(out, lambda r: r[0]):
            state, audit = C.START, ""
            for _, _, role, _, edits, live, _, deletions, _ in reversed(list(part)):
                while live and edits[state] == "I":
                    audit, state = audit + "I", C.DUE[state][1]
                if live:
                    audit += edits[state]
                    state = C.AFTER[role[0]][state] if edits[state] == "K" else C.DUE[state][1] if edits[state] == "R" else state
                audit += "D" * deletions
            found[c] = audit
        return found
    assert audits(4096) == audits(3) == audits(1)


def test_one_long_conversation(spark):
    """Thousands of rows, two thirds of them one repeated row, in one conversation."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(6000)] + [(1, 3, "assistant", "Row 3.")] * 12000
    got = C.repair(frame(spark, rows)).collect()[0]
    assert (got.duplicate, got.cost, got.gaps) == (12000, 36000, 0) and got.audit == "KKKK" + "D" * 12000 + "K" * 5996


def test_query_columns(spark):
    got = queries.op11_conversation_repair(spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
