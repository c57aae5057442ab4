"""Near-duplicate groups with SetSketch registers (operator 7).

Texts are lower-cased (A-Z only) and cut into words; a document's set is its distinct
two-word shingles.  Documents whose sets have a Jaccard similarity of at least 0.8 are
linked, and every connected component keeps its smallest ``doc_id``.

1. One Arrow pass gives each document its set size, a 128-bit digest of the set and ``m``
   SetSketch registers: ``floor(1 - log_b(x_i))`` of the least exponential variate ``x_i``
   of the set, truncated to 16 bits.
2. Documents with equal sets are one class (a grouped aggregate); only one member of a
   class goes on, so thousands of copies are one row.
3. Bands of four registers are hashed.  In each band bucket every class is paired with the
   bucket's least class only, so a bucket of any size gives a linear number of pairs.
4. A pair goes on if the likelihood of its registers (joint estimate from the counts of
   greater, smaller and equal registers and the exact set sizes) does not rule it out;
   then the full sets are compared.
5. Components of the confirmed links.  A second round looks at the buckets that still hold
   more than one component and compares the members outside the least class's component
   with the bucket's other members, so no candidate of the bands is left out.  A pair
   becomes a row once, in the first bucket it shares, and only if an odd sketch (parities
   of hashed shingles, which give the size of the symmetric difference of similar sets
   closely) does not rule it out.  Of every two components the closest pair is confirmed
   first; then all pairs whose components are still apart are.

Nulls and texts without a word have an empty set and are linked with nothing.  Rows that
repeat a ``doc_id`` each keep a row of the result.  A null ``doc_id`` is never the smallest
of a group that has another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from propkit.llm import _text as T
from propkit.llm._spark import components, stored

REGISTERS, BAND = 128, 4
RATE, LOG_BASE, TOP = 20.0, 0.001, 65534  # SetSketch a, ln b, q
ROUND_TWO_MATCHES = 2  # bands that must agree for a second-round pair (missed at 0.8: about 1e-6)
ODD_BITS, ODD_SIGMAS = 2048, 4.5
SMALL_IDS = 1_000_000  # ids that may be broadcast (8 MB); more are joined by a shuffle

_MULT = (np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, ends: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their bounds."""
    buf = T.LOWER[buf]
    s, e, wb = T.words(buf, ends)
    h = T.span_hash(buf, s, e)
    own = T.owner(wb)
    if len(h) >= width:
        g = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            g = g * _STEP + h[i: len(h) - width + 1 + i]
        inside = own[: len(g)] == own[width - 1:]
        g, go = T.mix(g[inside]), own[: len(inside)][inside]
    else:
        g, go = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((np.diff(wb) > 0) & (np.diff(wb) < width))
    for i in few:  # fewer words than a shingle: the whole sequence is one
        x = h[wb[i]: wb[i] + 1] * _ONE
        for w in h[wb[i] + 1: wb[i + 1]]:
            x = x * _STEP + w
        g, go = np.append(g, T.mix(x)), np.append(go, i)
    order = np.argsort(g)
    g, go = g[order], go[order]
    order = np.argsort(go.astype(np.uint16) if len(ends) < 65536 else go, kind="stable")
    g, go = g[order], go[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (go[1:] != go[:-1])
    g, go = g[new], go[new]
    return g, np.searchsorted(go, np.arange(len(ends) + 1))


def registers(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of the non-empty sets among ``bounds``."""
    full = np.flatnonzero(np.diff(bounds))
    low = np.empty((len(full), REGISTERS), np.uint64)
    if len(full):
        at = bounds[:-1][full]
        for i in range(REGISTERS):
            low[:, i] = np.minimum.reduceat(g * _MULT[i] + _ONE, at)
    u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    k = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / LOG_BASE)
    return np.clip(k, 0, TOP).astype("<u2")


def _digests(g: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each set, None for an empty one."""
    raw = g.astype("<u8")
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def odd_sketch(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bit ``i`` is the parity of the number of a set's shingles that hash to ``i``."""
    own = T.owner(bounds)
    n = len(bounds) - 1
    bits = np.zeros(n * ODD_BITS, np.uint8)
    np.bitwise_xor.at(bits, own * ODD_BITS + (g >> np.uint64(53)).astype(np.int64), 1)
    return np.packbits(bits.reshape(n, ODD_BITS), axis=1, bitorder="little").view("<i8")


def odd_limit(na: Column, nb: Column, percent: int) -> Column:
    """Differing bits that two sets of these sizes linked at ``percent`` can have (``ODD_SIGMAS``
    standard deviations above the mean at the largest symmetric difference)."""
    n, d = float(ODD_BITS), (na + nb).cast("double") * ((100 - percent) / (100 + percent))
    one, two = F.pow(F.lit(1 - 2 / n), d), F.pow(F.lit(1 - 4 / n), d)
    variance = n / 4 * (1 - two) + n * n / 4 * (two - one * one)
    return n / 2 * (1 - one) + ODD_SIGMAS * F.sqrt(F.greatest(variance, F.lit(0.0))) + 1


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(1)):
                g, bounds = shingle_sets(buf, ends, width)
                size = np.diff(bounds)
                rows = iter(registers(g, bounds))
                sk = [next(rows).tobytes() if n else None for n in size]
                odd = odd_sketch(g, bounds)
                offs = pa.array(np.arange(0, odd.size + 1, odd.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ends)), pa.array(size, pa.int64()), pa.array(_digests(g, bounds), pa.binary()),
                     pa.array(sk, pa.binary()), pa.ListArray.from_arrays(offs, pa.array(odd.reshape(-1)))],
                    names=["doc_id", "n_shingles", "cls", "sketch", "odd"])
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = REGISTERS // BAND
    salt = T.mix(np.arange(1, n_bands + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, n_bands, BAND).astype(np.uint64)
        h = np.broadcast_to(salt, k.shape[:2]).copy()
        for i in range(BAND):
            h = T.mix(h * _STEP + k[:, :, i])
        flat = pa.array(h.reshape(-1).view(np.int64))
        offs = pa.array(np.arange(0, len(flat) + 1, n_bands, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offs, flat)], names=["cid", "n", "bands"])


def joint_estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows, given the set sizes."""
    gt, lt = (ka > kb).sum(1)[:, None], (ka < kb).sum(1)[:, None]
    eq = ka.shape[1] - gt - lt
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    c = -np.expm1(-LOG_BASE)  # (b - 1) / b

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * c) / LOG_BASE

    for _ in range(2):  # the likelihood is concave: a grid, then a finer one around its best point
        j = lo + (hi - lo) * np.linspace(0, 1, 41)
        a, b = p(u - v * j), p(v - u * j)
        ll = gt * np.log(a + 1e-12) + lt * np.log(b + 1e-12) + eq * np.log(np.maximum(1 - a - b, 1e-12))
        best, step = np.take_along_axis(j, ll.argmax(1)[:, None], 1), (hi - lo) / 40
        lo, hi = np.maximum(best - step, 0), np.minimum(best + step, hi)
    return best[:, 0]


def _likely(threshold: float):
    # six standard deviations of the estimate at the threshold: only hopeless pairs go
    least = threshold - 6 * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ka, kb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ska", "skb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            ok = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (joint_estimate(ka, kb, na, nb) >= least)
            yield batch.select(["a", "b", "ida", "idb", "clsa", "clsb"]).filter(pa.array(ok))
    return run


def _confirm(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, list[np.ndarray]] = {"a": [], "b": []}
            same = np.ones(batch.num_rows, bool)  # not another row with the same doc_id
            for side, out in sets.items():
                cls, i = batch.column(f"cls{side}").to_pylist(), 0
                for _, buf, ends in T.blocks(batch.column(f"t{side}")):
                    g, bounds = shingle_sets(buf, ends, width)
                    out += [g[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                    for d in _digests(g, bounds):
                        same[i] &= d == cls[i]
                        i += 1
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets["a"], sets["b"])], np.int64)
            size = np.array([len(x) + len(y) for x, y in zip(sets["a"], sets["b"])], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(same & (100 * both >= percent * (size - both)), pa.bool_()))
    return run


def _moved(df: DataFrame, col: str, to: DataFrame) -> DataFrame:
    """``df`` with the nodes in ``col`` replaced by their roots in ``to``, where they have one."""
    to = to.select(F.col("node").alias("_pk_node"), F.col("root").alias("_pk_root"))
    out = df.join(to, df[col] == F.col("_pk_node"), "left")
    return out.withColumn(col, F.coalesce("_pk_root", col)).drop("_pk_node", "_pk_root")


def near_duplicates(docs: DataFrame, threshold_percent: int = 80, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, cls, root)`` for every row of ``docs``; ``cls`` is
    the digest of the row's set of ``width``-word shingles and ``root`` numbers its component
    (null if the set is empty)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = stored(texts.mapInArrow(_sketch(width), "doc_id long, n_shingles long, cls binary, sketch binary, odd array<long>"))
    classes = stored(s.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("odd").alias("odd"))
        .withColumn("cid", F.monotonically_increasing_id()))
    bands = stored(classes.select("cid", "n", "sketch").mapInArrow(_bands, "cid long, n long, bands array<long>"))
    member = bands.select("cid", "n", F.explode("bands").alias("key"))
    least = member.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("f"), F.count(F.lit(1)).alias("seats")).where("seats > 1")
    shared = stored(member.join(least.select("key", F.col("f.cid").alias("first"), F.col("f.n").alias("first_n")), "key"))  # buckets with company
    near_size = 100 * F.least("n", "first_n") >= threshold_percent * F.greatest("n", "first_n")
    tried = shared.where((F.col("cid") != F.col("first")) & near_size).select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("cid").alias(x), F.col("doc_id").alias(f"id{x}"),
                                        F.col("n").alias(f"n{x}"), F.col("cls").alias(f"cls{x}"), F.col("sketch").alias(f"sk{x}"))
        likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
            _likely(threshold_percent / 100), "a long, b long, ida long, idb long, clsa binary, clsb binary"))
        need = likely.select(F.col("ida").alias("id")).unionByName(likely.select(F.col("idb").alias("id"))).distinct()
        if need.count() <= SMALL_IDS:  # else all texts are moved once
            need = F.broadcast(need)
        t = texts.join(need, texts["doc_id"].eqNullSafe(need["id"]), "left_semi")
        ta = t.select(F.col("doc_id").alias("xa"), F.col("text").alias("ta"))
        tb = t.select(F.col("doc_id").alias("xb"), F.col("text").alias("tb"))
        full = likely.join(ta, likely["ida"].eqNullSafe(ta["xa"])).join(tb, likely["idb"].eqNullSafe(tb["xb"]))
        return full.select("a", "b", "clsa", "clsb", "ta", "tb").mapInArrow(_confirm(threshold_percent, width), "a long, b long").distinct()

    links = stored(confirmed(tried))
    roots = components(links)
    # second round: buckets with several components
    seat = shared.join(roots, shared["cid"] == roots["node"], "left").select(
        "key", "cid", "n", "first", F.coalesce("root", "cid").alias("root"))
    mixed = seat.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                    F.max(F.when(F.col("cid") == F.col("first"), F.col("root"))).alias("main"))
    mixed = mixed.where("lo <> hi").select("key", "main")
    seats = seat.join(mixed, "key").join(bands.select("cid", "bands"), "cid").join(classes.select("cid", "odd"), "cid")
    seats = stored(seats.select("key", "cid", "root", "main", "n", "odd", "bands"))
    left = seats.where("root <> main").select("key", F.col("cid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"),
                                              F.col("odd").alias("ob"), F.col("bands").alias("bb"))
    right = seats.select("key", F.col("cid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("odd").alias("oa"),
                         F.col("bands").alias("ba"), "main")
    # what rules a pair out is looked at before it becomes a row
    common = F.array_intersect("ba", "bb")
    differing = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    cond = ((left["key"] == right["key"]) & (F.col("ra") != F.col("rb")) & ((F.col("ra") == F.col("main")) | (F.col("a") < F.col("b")))
            & (100 * F.least("na", "nb") >= threshold_percent * F.greatest("na", "nb"))
            & (differing <= odd_limit(F.col("na"), F.col("nb"), threshold_percent))
            & (F.size(common) >= ROUND_TWO_MATCHES) & (F.element_at(common, 1) == left["key"]))
    more = left.join(right, cond).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), differing.alias("far"),
                                         F.least("ra", "rb").alias("r"), F.greatest("ra", "rb").alias("s")).distinct()
    more = stored(more.join(tried, ["a", "b"], "left_anti"))
    moves = []  # components of components, from the links of this round
    # the closest pair of every two components first: its link spares the others of the two
    for closest in (True, False):
        take = more
        if closest:
            take = stored(more.groupBy("r", "s").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b", "r", "s"))
            more = more.join(take.select("a", "b"), ["a", "b"], "left_anti")
        if not take.limit(1).count():
            break
        found = stored(confirmed(take.select("a", "b")).join(take, ["a", "b"]).select("r", "s"))
        if found.limit(1).count():
            moves.append(components(found, "r", "s"))
            more = _moved(_moved(more, "r", moves[-1]), "s", moves[-1]).where("r <> s")
        if closest:
            more = stored(more)
    member_of = classes.select("cid", "cls", "doc_id").join(roots, classes["cid"] == roots["node"], "left").select(
        "cls", "doc_id", F.coalesce("root", "cid").alias("root"))
    for m in moves:
        member_of = _moved(member_of, "root", m)
    smallest = member_of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = member_of.join(smallest, "root").select("cls", "component_id", "root")
    out = s.select("doc_id", "n_shingles", "cls").join(answer, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"), "cls", "root")


def _with_class(width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, ends in T.blocks(batch.column(at)):
                dig = pa.array(_digests(*shingle_sets(buf, ends, width)), pa.binary())
                part = batch.slice(first, len(ends))
                yield pa.RecordBatch.from_arrays([*part.columns, dig], names=[*part.schema.names, "_pk_cls"])
    return run


def drop_near_duplicates(docs: DataFrame, threshold_percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, and every
    row with an empty set."""
    got = stored(near_duplicates(docs, threshold_percent, width, id_col, text_col))
    stay = got.where("kept").select(F.col("doc_id").alias("_pk_id"), F.col("cls").alias("_pk_c"))
    often = got.groupBy(F.col("doc_id").alias("_pk_id")).count().where("count > 1").select("_pk_id")
    if not often.limit(1).count():
        return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay["_pk_id"]), "left_semi")
    # rows that repeat a doc_id are told apart by their sets
    single = docs.join(often, docs[id_col].cast("long").eqNullSafe(often["_pk_id"]), "left_anti")
    several = docs.join(often, docs[id_col].cast("long").eqNullSafe(often["_pk_id"]), "left_semi")
    schema = StructType([*docs.schema.fields, StructField("_pk_cls", BinaryType())])
    several = several.mapInArrow(_with_class(width, docs.columns.index(text_col)), schema)
    # of a group's rows with its smallest doc_id the one with the least set stays
    least = got.where("kept and cls is not null").groupBy("root").agg(
        F.first("component_id").alias("_pk_id"), F.min("cls").alias("_pk_c"))
    kept = several.join(least, several[id_col].cast("long").eqNullSafe(least["_pk_id"]) & (several["_pk_cls"] == least["_pk_c"]), "left_semi")
    kept = kept.dropDuplicates([id_col, "_pk_cls"]).unionByName(several.where("_pk_cls is null"))
    return single.join(stay, single[id_col].cast("long").eqNullSafe(stay["_pk_id"]), "left_semi").unionByName(kept.select(*docs.columns))
