"""Sharding by jump consistent hashing, in DataFrame expressions only.

A row's key alone walks the jump sequence: the shard of n is the last jump below n, so one more
shard takes rows only into itself. The walk is the published one, with a 64-bit linear congruential
generator that is computed in two 32-bit halves, as Spark's longs do not wrap. The generator is
seeded with 64 bits of the key's MD5, which spreads neighbouring keys.

Slots number the rows of a shard from 0 without gaps. A shard may hold any share of the data, so its
rows are first dealt to a fixed number of sub-buckets by a hash of key and text; only the rows of
one sub-bucket are sorted together, and the sub-buckets' counts (shards x buckets, a bound that does
not grow with the data) give each its first slot.

Defined results: a null key hashes as the empty string; a null text has size 16 and the CRC of the
empty string; equal rows share a shard and get neighbouring slots. The law is `key`, so nothing else
of a row, nor an equal text elsewhere, moves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namekit.llm.tables import written

MULTIPLIER = 2862933555777941757
BUCKETS = 256
OVERHEAD_BYTES = 16
_M32 = 0xFFFFFFFF


def _hex(digest: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, (hi, lo) -> (hi, lo) * MULTIPLIER + 1 modulo 2^64."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & _M32
    mask = F.lit(_M32).cast("long")
    low, high = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(ml), F.shiftright(lo, 16) * F.lit(ml)
    total = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(high, 16)
    cross = (lo * F.lit(mh)).bitwiseAND(mask)
    upper = ((hi.bitwiseAND(F.lit(0xFFFF)) * F.lit(ml)).bitwiseAND(mask)
             + F.shiftleft((F.shiftright(hi, 16) * F.lit(ml)).bitwiseAND(F.lit(0xFFFF)), 16))
    return (carry + cross + upper).bitwiseAND(mask), total.bitwiseAND(mask)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): where the key goes among ``shards`` and ``shards`` + 1 shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    begin = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"),
                     F.lit(0).cast("long").alias("j"),
                     _hex(digest, 1, 8).alias("hi"), _hex(digest, 9, 8).alias("lo"))

    def step(s: Column, _: Column) -> Column:
        j = s["j"]
        hi, lo = _next(s["hi"], s["lo"])
        leap = (j + F.lit(1)).cast("double") * (
            F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))
        # beyond the shards the walk stands still
        return F.when(j > F.lit(shards), s).otherwise(F.struct(
            F.when(j < F.lit(shards), j).otherwise(s["b"]).alias("b"), j.alias("g"),
            F.least(F.floor(leap), F.lit(shards + 1)).cast("long").alias("j"), hi.alias("hi"), lo.alias("lo")))

    # every jump goes on by one at least
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), begin, step)
    return F.struct(walk["b"].cast("int").alias("shard"), walk["g"].cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                          (F.octet_length(text) + F.lit(OVERHEAD_BYTES)).cast("long").alias("size"),
                          F.crc32(text).alias("text_crc32"))
              .withColumn("to", jump_shards(F.col("doc_id"), shards))
              .select("doc_id", "size", "text_crc32", "to.shard", "to.grown_shard"))
    digest = F.md5(F.concat_ws(":", F.lit("slot"), "doc_id", "text_crc32").cast("binary"))
    # the texts are read once: sizes, checksums and shards are written, then counted and numbered
    narrow = written(narrow.withColumn("bucket", F.pmod(_hex(digest, 1, 8), F.lit(buckets)).cast("int")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (narrow.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
             .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    # at most shards x buckets rows
    return (narrow.withColumn("nth", F.row_number().over(within))
            .join(F.broadcast(first), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first") + F.col("nth") - F.lit(1)).cast("long").alias("slot"), "grown_shard"))
