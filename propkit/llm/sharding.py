"""Sharding by jump consistent hashing (operator 2), with DataFrame functions only.

The shard of a key depends on the key and the number of shards alone, there is no table of
ring positions, and one more shard takes rows only into itself.  The published
generator (a 64-bit linear congruential step) is kept in two 32-bit halves, because
Spark's long arithmetic does not wrap.  The slot of a row in its shard is a running
count over (shard, bucket), so a shard is never numbered by one task.

Integer keys are the hash's key themselves, other keys through ``xxhash64``; a null key is
key -1.  Null texts have no bytes (size 1, checksum 0).  Repeated rows share a shard and
have slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propkit.llm._spark import hash_key, running_sums

MULTIPLIER = 2862933555777941757
_HI, _LO, _MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF
MOST_JUMPS = 128  # jumps grow as the logarithm of the shards; the row fails loudly beyond


def _times_low(x: Column, by: int) -> tuple[Column, Column]:
    """``(low 32 bits, carry)`` of the product of two 32-bit numbers."""
    a, b = (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(by)), (F.shiftright(x, 16) * F.lit(by))
    low = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    return low, F.shiftright(b, 16)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``."""
    zero = F.lit(0).cast("long")
    start = F.struct((F.shiftrightunsigned(key, 32)).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"),
                     F.lit(-1).cast("long").alias("b"), zero.alias("j"))

    def step(s: Column, _: Column) -> Column:
        low, carry = _times_low(s["lo"], _LO)
        low = low + 1
        up, _c = _times_low(s["hi"], _LO)
        up2, _c2 = _times_low(s["lo"], _HI)
        hi = (F.shiftright(low, 32) + carry + up.bitwiseAND(F.lit(_MASK)) + up2.bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK))
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"), s["j"].alias("b"),
                         F.least(jump, F.lit(1 << 40)).cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def shard(s: Column) -> Column:
        done = s["b"].cast("int")
        return done if shards <= MOST_JUMPS else F.when(s["j"] >= shards, done).otherwise(
            F.raise_error("jump hash did not end").cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step, shard)


def shard_key(docs: DataFrame, col: str) -> Column:
    whole = dict(docs.dtypes)[col] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(col).cast("long") if whole else F.when(F.col(col).isNotNull(), F.xxhash64(col)), F.lit(-1).cast("long"))


def assign_shards(docs: DataFrame, shards: int = 8, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    text = F.col(text_col).cast("string")
    x = docs.select(F.col(key_col).alias("doc_id"), shard_key(docs, key_col).alias("key"),
                    (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                    F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    x = x.withColumn("shard", jump_hash(F.col("key"), shards)).withColumn("grown_shard", jump_hash(F.col("key"), shards + 1))
    x = running_sums(x, ["shard"], hash_key(F.col("key")), ["key", "text_crc32", "size"], {"slot": F.lit(1)}, docs.count())
    return x.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
