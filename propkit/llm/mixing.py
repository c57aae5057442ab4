"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Slot ``i`` of the mix takes the point ``i * phi mod 1`` (kept as a 31-bit integer), and the
cumulative targets map it to a source, so every stretch of the schedule holds each
source in nearly its share.  Slots are ranked per source.  A source's documents stand in a
shuffled order on a tape of words that is cut into blocks of ``block_words`` words; the
slot of rank ``r`` takes block ``r`` of the tape, repeated up to ``most_repeats`` times and
ended at the target.  Where the discrepancy leaves a source some slots short, they follow
at the end of the schedule, so every source yields its target to the word.  Every taken piece
keeps its slot, so the mix can be read in an order in which each stretch holds the shares.

Target of a source: ``weight / sum of weights`` of ``share`` times all words, at most
``most_repeats`` times the source's words; the excess goes to the others by weight.

The hot source is no group of its own: tape positions and ranks are running sums over
(source, bucket), and blocks are joined on (source, block).

Null texts have no words and null sources are a source (last in order).  Documents without
words, and all when there are no words at all, take 0.  Repeated rows each have their own
place on the tape.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propkit.llm._spark import WORD, hash_key, running_sums, stored, tmp
from propkit.operators.rowid import with_row_index

PHI31 = 1327217885  # 2**31 / golden ratio, odd: a permutation of the 31-bit residues
CIRCLE = 1 << 31


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most_repeats: int) -> tuple[DataFrame, int]:
    """``(src, source, source_size, weight, target, words)`` by source, and the sum of ``words``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(totals, name="src", order_by=[F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    src = stored(ranked.withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(float(most_repeats))
    everything = src.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (everything[0] or 0)
    level = budget / everything[1] if everything[1] else 0.0
    while True:  # raise the level until the capped sources' excess is given away
        full = F.col("weight") * F.lit(level) >= cap
        capped, free = src.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (budget - (capped or 0.0)) / free if free else level
        if raised <= level:
            break
        level = raised
    src = src.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))
    src = stored(src.withColumn("words", F.least(F.round("target"), cap).cast("long")))
    return src, src.agg(F.sum("words")).first()[0] or 0


def schedule(src: DataFrame, words: int, block_words: int) -> DataFrame:
    """The mix: ``(slot, src, rank)``, slot by slot; ``src`` as ``source_targets`` gives it."""
    spark = src.sparkSession
    n_src, slots = max(src.count(), 1), -(-words // block_words)
    bits = min(30, math.ceil(math.log2(n_src)) + 8)
    lanes = running_sums(src.select("src", "words", F.lit(0).alias("all")), ["all"], F.col("src"), [], {"lo": F.col("words")}, n_src)
    edge = lambda c: F.floor(c / F.lit(float(max(words, 1))) * F.lit(float(CIRCLE)))
    lanes = lanes.select("src", edge(F.col("lo")).alias("lo"), edge(F.col("lo") + F.col("words")).alias("hi")).where("hi > lo")
    cells = lanes.withColumn("cell", F.explode(F.sequence(
        F.shiftright("lo", 31 - bits), F.shiftright(F.col("hi") - 1, 31 - bits))))
    point = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * PHI31 % CIRCLE).alias("u"))
    point = point.withColumn("cell", F.shiftright("u", 31 - bits))
    taken = point.join(cells, "cell").where("u >= lo and u < hi").select("slot", "src")
    span = max(1, math.isqrt(max(slots, 1)))
    ranked = running_sums(taken, ["src"], F.col("slot"), [], {"rank": F.lit(1)}, slots, bucket=F.floor(F.col("slot") / span))
    need = src.select("src", F.ceil(F.col("words") / block_words).alias("need"))
    have = taken.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    short = need.join(have, "src", "left").where("need > coalesce(have, 0)").select(
        "src", F.explode(F.sequence(F.coalesce("have", F.lit(0).cast("long")), F.col("need") - 1)).alias("rank"), F.coalesce("have", F.lit(0)).alias("have"))
    ranked = ranked.join(need, "src").where("rank < need").select("slot", "src", "rank")
    behind = (F.lit(slots) + (F.col("rank") - F.col("have")) * n_src + F.col("src")).cast("long")
    return ranked.unionByName(short.select(behind.alias("slot"), "src", "rank"))


class Mix:
    """A mix of ``docs``: ``tape`` has a row per document, ``pieces`` one per block that a document is
    taken into: ``(row, turn, slot, part)``, ``part`` words in the mix's block number ``slot``.

    ``rows`` are the documents with their number ``row`` (under the free name ``number``)."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most_repeats: int = 2,
                 block_words: int = 256, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.number = tmp(docs, "row")
        self.rows = with_row_index(docs, self.number)
        text = F.col(text_col).cast("string")
        sizes = self.rows.select(F.col(self.number).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                 F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                                 F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc"))
        sizes = stored(sizes.withColumn("key", hash_key(F.lit(seed), F.col("doc_id"))))
        src, words = source_targets(sizes, weights, share, most_repeats)
        named = sizes.join(src.select("source", "src", "source_size", "target", "words").withColumnRenamed("source", "_s"),
                           F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        tape = running_sums(named, ["src"], F.col("key"), ["doc_id", "size", "text_crc", "row"], {"at": F.col("size")}, sizes.count())
        self.tape = stored(tape.drop("key"))
        lo = F.col("at") + F.col("turn") * F.col("source_size")
        turn = self.tape.select("row", "src", "at", "size", "source_size", "words", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("turn"))
        turn = turn.select("row", "src", "turn", lo.alias("lo"), F.least(lo + F.col("size"), F.col("words")).alias("hi")).where("hi > lo")
        piece = turn.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
        part = F.least("hi", (F.col("block") + 1) * block_words) - F.greatest("lo", F.col("block") * block_words)
        piece = piece.select("row", "turn", "src", "block", part.alias("part"))
        slots = schedule(src, words, block_words).select("src", F.col("rank").alias("block"), "slot")
        self.pieces = piece.join(slots, ["src", "block"]).select("row", "turn", "slot", "part")


def mix(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, text_crc, size, source, source_size, target, taken)`` for every row of ``docs``.

    ``weights`` go to the sources in code-point order, null last, and repeat; for the other
    arguments see ``Mix``."""
    m = Mix(docs, **how)
    got = m.pieces.groupBy("row").agg(F.sum("part").alias("taken"))
    return m.tape.join(got, "row", "left").select(
        "doc_id", "text_crc", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def first_words(text, n):
    """The text up to the end of its ``n``-th word, as a column."""
    cut = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(cut, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, text_col: str = "text", slot_col: str | None = None, **how) -> DataFrame:
    """The documents of the mix with all their columns: a row for each time a document is
    taken; the last one of a source ends where the taken words end.

    ``slot_col`` adds the block of the mix in which the row begins; in its order every stretch
    of the mix holds the sources in nearly their shares.  Repeated rows stay rows of their own.
    Documents without words are not taken; without words at all nothing is."""
    m = Mix(docs, text_col=text_col, **how)
    names = [tmp(m.rows, n) for n in ("taken_row", "words", "slot", "size")]
    row, words, slot, size = names
    got = m.pieces.groupBy("row", "turn").agg(F.sum("part").alias(words), F.min("slot").alias(slot))
    got = got.join(m.tape.select("row", "size"), "row").select(F.col("row").alias(row), words, slot, F.col("size").alias(size))
    text = F.col(text_col).cast("string")
    x = m.rows.join(got, F.col(m.number) == F.col(row))
    x = x.withColumn(text_col, F.when(F.col(words) == F.col(size), text).otherwise(first_words(text, F.col(words))))
    return x.select(*docs.columns, *([F.col(slot).alias(slot_col)] if slot_col else []))
