"""Repair of the turn structure of conversations (operator 11).

A conversation's rows stand in order of turn (nulls first; then role and the SHA-256 of the
text).  It is repaired by edits: Keep a row, Rerole it, Delete it, or Insert an empty row,
so that the first letters of the roles read ``(s?(ua)+)?``.  Blank rows and rows whose role
and text were seen earlier must be deleted.

The cheapest edits are a lightest derivation.  An item ``(i, q)`` says that the rows from
``i`` on, met in state ``q``, can be repaired; a deduction puts one edit before such a repair.
Knuth's agenda pops items in order of ``(cost, rows used, first edit)``: every deduction
raises the cost or the rows used, and puts the same letter before both of two repairs, so it
is superior and monotone, and an item is final when it is popped first.  Two repairs of one
item that begin with the same edit go on from the same item, so the first letters decide
between equal costs and the audits need not be kept.

Nothing holds a whole conversation.  The agenda runs over ``CHUNK`` rows at a time, from the
last row to the first, and only the costs of the four states pass from one chunk to the one
before it.  A second pass in order of the rows follows the edits, hashes the repaired rows
and writes them.  That pass is one task a conversation, as a SHA-256 of it has to be; its
memory does not grow with the conversation, but for the audit that it returns.  Repeats are
found by grouping, so a row that a third of the table repeats is one row.

Null roles and texts are one blank.  Conversations with a null id are one conversation.  An
empty role has no legal letter.  Columns other than the four are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from propkit.llm._spark import WS

CHUNK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)  # states, named by the role met last
#: The state after each letter in each state (none: not legal), and after the letter that is due.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
AT_END = (0, 4, 2, 0)  # what a conversation costs that ends in each state: pending roles are inserted
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the damage that their ids and turns call for;
    ``copies`` is 2 for a repeated row."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                                        F.when(kind == 3, 2).otherwise(1).alias("copies"))


# ---- the agenda -----------------------------------------------------------------

@functools.lru_cache(1 << 16)
def agenda(steps: tuple[tuple[str, bool, int], ...], after: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The first edit of every item and the costs of the four states before the first step.

    A step is ``(letter of the role, truncated, deletions)``: a row, or with ``deletions`` that
    many rows that have to go.  ``after`` are the costs of the states behind the last step."""
    heap = [(cost, 0, "", len(steps), q) for q, cost in enumerate(after)]
    heapq.heapify(heap)
    first: dict[tuple[int, int], str] = {}
    costs, open_ = [0] * 4, 4
    while open_:
        cost, used, edit, i, q = heapq.heappop(heap)
        if (i, q) in first:
            continue
        first[i, q] = edit
        if i == 0:
            costs[q], open_ = cost, open_ - 1
        for p in range(4):
            if DUE[p][1] == q:
                heapq.heappush(heap, (cost + INSERT, used, "I", i, p))
        if i == 0:
            continue
        letter, truncated, deletions = steps[i - 1]
        heapq.heappush(heap, (cost + DELETE * max(deletions, 1), used + 1, "D", i - 1, q))
        if not deletions:
            for p in range(4):
                if AFTER.get(letter, {}).get(p) == q:
                    heapq.heappush(heap, (cost + TRUNCATED * truncated, used + 1, "K", i - 1, p))
                if DUE[p][1] == q:
                    heapq.heappush(heap, (cost + REROLE + TRUNCATED * truncated, used + 1, "R", i - 1, p))
    return tuple("".join(first.get((i, q), "-") for q in range(4)) for i in range(len(steps))), tuple(costs)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(rows, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _decide(rows: list[tuple], after: tuple[int, ...]) -> tuple[list[tuple], tuple[int, ...]]:
    steps, at = [], {}
    for k in range(len(rows) - 1, -1, -1):  # in order; a first row stands before its repeats
        _, _, role, _, live, truncated, deletions, _ = rows[k]
        if live:
            at[k] = len(steps)
            steps.append((role[:1], truncated, 0))
        if deletions:
            steps.append((role[:1], False, deletions))
    edits, costs = agenda(tuple(steps), after)
    return [(*row[:4], edits[at[k]] if k in at else None, *row[4:]) for k, row in enumerate(rows)], costs


def _backward(schema: pa.Schema):
    """Rows come conversation by conversation, from the last to the first.  Every row that may
    stay gets its first edit for each state in which it may be met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided():
            for _, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
                after = AT_END
                while part := list(itertools.islice(rows, CHUNK)):
                    done, after = _decide(part, after)
                    yield from done
        yield from _batches(decided(), schema)
    return run


# ---- the repair -------------------------------------------------------------------

def _events(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(edit, times, turn, role, text)`` in order for one conversation, then its counts.

    A row is ``(conv_id, turn, role, hash, kind, edits, live, truncated, deletions, blank, text)``:
    kind 0 is the conversation itself, 1 a row with its edits, 2 its text."""
    n = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    state, last, low, high, turns, wanted = START, None, None, None, 0, None
    for _, turn, role, digest, kind, edits, live, truncated, deletions, blank, text in rows:
        if kind == 2 and wanted and wanted[0] == (turn, role, digest):
            yield wanted[1], 1, turn, wanted[2], text
            if wanted[3]:  # the repeats of a row that stays come after it
                yield "D", wanted[3], turn, role, None
            wanted = None
        if kind != 1:
            continue
        if wanted:
            raise RuntimeError(f"no text for the row {wanted[0]}")
        if turn is not None and turn != high:
            low, high, turns = turn if low is None else low, turn, turns + 1
        letter = role[:1]
        n["illegal"] += (deletions + live - 1) + (last is not None and last + letter not in LEGAL)
        n["blank" if blank else "duplicate"] += deletions
        n["truncated"] += live and truncated
        n["cost"] += DELETE * deletions
        last = letter
        while live and edits[state] == "I":
            n["cost"] += INSERT
            yield "I", 1, None, DUE[state][0], ""
            state = DUE[state][1]
        if live and edits[state] == "D":
            n["cost"] += DELETE
            deletions += 1
        elif live:
            n["cost"] += TRUNCATED * truncated + REROLE * (edits[state] == "R")
            to_role, to = (role, AFTER[letter][state]) if edits[state] == "K" else DUE[state]
            state, wanted = to, ((turn, role, digest), edits[state], to_role, deletions)
            continue
        if deletions:
            yield "D", deletions, turn, role, None
    if wanted:
        raise RuntimeError(f"no text for the row {wanted[0]}")
    while state not in (START, ASSISTANT):
        n["cost"] += INSERT
        yield "I", 1, None, DUE[state][0], ""
        state = DUE[state][1]
    n["gaps"] = high - low + 1 - turns if turns else 0
    yield None, n


def _digest(rows: Iterator[tuple]) -> tuple:
    sha, audit, begun = hashlib.sha256(), [], False
    for event in _events(rows):
        if event[0] is None:
            n = event[1]
            break
        edit, times, _, role, text = event
        audit.append(edit * times)
        if edit != "D":
            sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
    return *n.values(), "".join(audit), sha.hexdigest()


def _forward(schema: pa.Schema, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for conv, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
                if digests:
                    yield conv, *_digest(rows)
                    continue
                place = 0
                for edit, times, turn, role, text in (e for e in _events(rows) if e[0]):
                    for _ in range(times):
                        yield conv, place, edit, turn, role, text
                        place += 1
        yield from _batches(lines(), schema)
    return run


def _arrow(spark_schema: ST.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark_schema)


def _repair(rows: DataFrame, ids: DataFrame, out: str, digests: bool) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) through both passes; ``ids`` are all conversations."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies",
                       F.unhex(F.sha2("text", 256)).alias("hash"))
    key = ["conv_id", "turn", "role", "hash"]
    same = rows.groupBy(*key).agg(
        F.sum("copies").cast("long").alias("n"), F.max(~F.col("text").rlike(f"[^{WS}]")).alias("blank"),
        F.max(~F.col("text").rlike(rf"[.!?][{WS}]*\z")).alias("truncated"))
    # where each role and text comes first: one row of ``same`` each, so the join has no hot key
    first = same.groupBy("conv_id", "role", "hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("t"))).alias("f"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "f.t", F.lit(True).alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    live = F.col("first").isNotNull() & ~F.col("blank")
    steps = same.join(first, on, "left").select(*key, live.alias("live"), (live & F.col("truncated")).alias("truncated"),
                                                (F.col("n") - live.cast("long")).alias("deletions"), "blank")
    last = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("hash").desc()]
    narrow = steps.repartition(F.col("conv_id")).sortWithinPartitions(*last)
    decided = f"conv_id {conv}, turn long, role string, hash binary, edits string, live boolean, truncated boolean, deletions long, blank boolean"
    edits = narrow.mapInArrow(_backward(_arrow(ST._parse_datatype_string(decided))), decided)
    nothing = lambda t: F.lit(None).cast(t)
    every = ids.select("conv_id", nothing("long").alias("turn"), nothing("string").alias("role"), nothing("binary").alias("hash"), F.lit(0).alias("kind"))
    texts = rows.select(*key, F.lit(2).alias("kind"), "text")
    stream = every.unionByName(edits.withColumn("kind", F.lit(1)), True).unionByName(texts, True)
    stream = stream.select(*key, "kind", "edits", "live", "truncated", "deletions", "blank", "text")
    ordered = stream.repartition(F.col("conv_id")).sortWithinPartitions(*key, "kind")
    out = out.format(conv=conv)
    return ordered.mapInArrow(_forward(_arrow(ST._parse_datatype_string(out)), digests), out)


DIGEST = ("conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
ROWS = "conv_id {conv}, place long, edit string, turn long, role string, text string"


def _given(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, turn, role, text)``: every edit of every conversation in order; rows
    with edit ``D`` are those that went (their text is null), the others are the repaired conversation."""
    return _repair(_given(rows), rows.select("conv_id").distinct(), ROWS, False)


def repair(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and the hash of the repaired rows, one row a conversation."""
    return _repair(_given(rows), rows.select("conv_id").distinct(), DIGEST, True)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation of ``rows``."""
    return _repair(damage(rows), rows.select("conv_id").distinct(), DIGEST, True)
