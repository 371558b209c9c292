"""Shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the paper's 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
_M22, _M20 = (1 << 22) - 1, (1 << 20) - 1
_A = [MULTIPLIER & _M22, MULTIPLIER >> 22 & _M22, MULTIPLIER >> 44]


def next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64. The product is made of 22-bit limbs, so nothing overflows under ANSI rules."""
    a = [F.lit(x).cast("long") for x in _A]
    k0 = key.bitwiseAND(F.lit(_M22))
    k1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_M22))
    k2 = F.shiftrightunsigned(key, 44)
    low = k0 * a[0] + 1
    mid = k0 * a[1] + k1 * a[0] + F.shiftrightunsigned(low, 22)
    top = (k0 * a[2] + k1 * a[1] + k2 * a[0] + F.shiftrightunsigned(mid, 22)).bitwiseAND(F.lit(_M20))
    return F.shiftleft(top, 44).bitwiseOR(F.shiftleft(mid.bitwiseAND(F.lit(_M22)), 22)).bitwiseOR(low.bitwiseAND(F.lit(_M22)))


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. One more shard takes 1 / (shards + 1) of the keys, and moves no other.

    The paper's loop ends after about ln(shards) jumps and never takes more than `shards`; it is run in rounds of 8
    jumps, and a round is skipped once the loop has ended."""

    def step(s: Column) -> Column:
        state = next_state(s["key"])
        j = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), j.cast("long").alias("j"), state.alias("key"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def turn(s: Column) -> Column:
        run = F.aggregate(F.sequence(F.lit(1), F.lit(8)), s, lambda acc, _: step(acc))
        return F.when(s["j"] < shards, run).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), key.cast("long").alias("key"))
    rounds = max(1, -(-shards // 8))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda acc, _: turn(acc), lambda acc: acc["b"]).cast("int")


def shard(docs: DataFrame, shards: int = 16, grown: int | None = None, key: str = "doc_id") -> DataFrame:
    """docs with `shard`, and `grown_shard` (the shard were there `grown` of them, one more by default).

    The key is hashed first, as neighbouring keys make the generator's first numbers alike. A null key has one fixed
    shard; rows of one key are always together."""
    hashed = F.xxhash64(F.col(key).cast("string"))
    return docs.withColumns({"shard": jump(hashed, shards), "grown_shard": jump(hashed, grown or shards + 1)})


def with_slots(rows: DataFrame, by: str, order: list[str], salts: int = 64) -> DataFrame:
    """rows with `slot`: 0, 1, 2, ... within each value of `by`, without a gap.

    Ranks are taken in `salts` groups of each value and moved up by the rows of the groups before, so that a value with a
    third of all rows, or few values, still spread over many tasks. Raise salts with the corpus."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(by, "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(F.col(by).alias("__by"), F.col("__salt").alias("__of"), before.alias("__base"))
    nth = F.row_number().over(W.partitionBy(by, "__salt").orderBy(*order)) - 1
    ranked = salted.withColumn("__nth", nth)
    joined = ranked.join(base, ranked[by].eqNullSafe(F.col("__by")) & (F.col("__salt") == F.col("__of")))
    return joined.withColumn("slot", (F.col("__base") + F.col("__nth")).cast("long")).drop("__salt", "__n", "__by", "__of", "__base", "__nth")


def shard_documents(docs: DataFrame, shards: int = 16, salts: int = 64) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32 (of a null text: of no bytes), law, shard,
    slot, grown_shard. Texts are read for their size and checksum, and not shuffled."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_slots(shard(narrow, shards), "shard", ["doc_id", "size", "text_crc32"], salts)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
