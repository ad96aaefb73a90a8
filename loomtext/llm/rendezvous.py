"""Operator 2: weighted rendezvous sharding (native).

Every (record key, shard) pair gets a hash ``u`` in (0, 1); a record goes to
the shard with the least ``-ln(u) / weight``.  The winner is proportional to
the weights, depends on the key and the shard list alone, and adding a shard
only moves the rows the new shard wins.

Defined cases: a null key hashes as the empty string; a null text has size 1
and the CRC of no bytes; repeated rows get a slot each; an empty table gives
an empty result.  Extra input columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

SHARDS = 16
#: Hex digits of the slot bucket: 4,096 buckets a shard, 16 x 4,096 groups.
BUCKET_HEX = 3


def unit_hash(key: Column, salt: str) -> Column:
    """52 bits of md5(key:salt) as a double in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_score(key: Column, shard: int, weight: float) -> Column:
    return -F.ln(unit_hash(key, str(shard))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winning shard; weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(F.array(*[
        F.struct(shard_score(key, i, w).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)]))


def shard_documents(df: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS,
                    new_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot and the shard after one more shard joins.

    Slots number a shard's rows by (bucket, key, size, crc): rows are counted
    per (shard, bucket), the counts (at most shards x 4,096 rows) become bucket
    bases, and a window numbers each small bucket.  Repeated rows are counted
    before the shuffle and expanded after it, so no key gathers many rows.
    """
    t = text_or_empty(text)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    base = df.select(
        F.col(key), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), k.alias("_k"))
    won = base.withColumn("_w", rendezvous(F.col("_k"), weights)).select(
        key, "size", "text_crc32",
        F.col("_w.shard").alias("shard"),
        F.when(shard_score(F.col("_k"), len(weights), new_weight) < F.col("_w.score"),
               F.lit(len(weights))).otherwise(F.col("_w.shard")).alias("grown_shard"),
        F.substring(F.md5(F.col("_k")), 1, BUCKET_HEX).alias("_b"))
    cols = [key, "size", "text_crc32", "shard", "grown_shard", "_b"]
    rows = won.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy("shard", "_b").agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_b").orderBy(key, "size", "text_crc32") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))) \
        .join(F.broadcast(bases), ["shard", "_b"])
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("_base") + F.col("_at"),
                             F.col("_base") + F.col("_at") + F.col("_n") - 1)).alias("slot"),
        "grown_shard")
