"""Sharding by jump consistent hashing, in Spark expressions only.

A stable key and the number of shards alone decide a row's shard; no ring table
is kept. With one more shard, a row stays or moves into the new shard.

The published generator multiplies 64-bit integers modulo 2**64. Spark's
arithmetic checks overflow, so the product is put together from halves of 32
bits that never overflow.

Edge cases: a null key counts as 0; a null text has size 1 (no bytes, plus 1) and the
CRC of the empty text; repeated rows go to one shard, with slots of their own; rows of
one doc_id are put in order by CRC and size; an empty table gives an empty result; other
columns are ignored. Texts of any length are measured in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the published generator.
_M = 2862933555777941757
_MH, _ML = _M >> 32, _M & 0xFFFFFFFF
_LOW = 0xFFFFFFFF
#: Draws in a run.
_AT_ONCE = 16
#: Rows of the table of offsets up to which it is broadcast, some 2 MB.
_OFFSETS = 65_536


def _next(hi: Column, lo: Column) -> Column:
    """key * _M + 1 modulo 2**64, as halves."""
    q = F.shiftright(lo, 16) * _ML
    low = lo.bitwiseAND(F.lit(0xFFFF)) * _ML + F.shiftleft(q.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    top = F.shiftleft((F.shiftright(hi, 16) * _ML).bitwiseAND(F.lit(0xFFFF)), 16) + hi.bitwiseAND(F.lit(0xFFFF)) * _ML
    high = F.shiftright(low, 32) + F.shiftright(q, 16) + lo * _MH + top
    return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), low.bitwiseAND(F.lit(_LOW)).alias("lo"))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def jump_hash(key: Column | str, shards: int) -> Column:
    """The shard of a 64-bit key, from 0 to ``shards`` - 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(0)).cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"), F.lit(0).cast("long").alias("b"), F.lit(False).alias("done"))

    def jump(s: Column, drawn: Column) -> Column:
        at = F.floor((s["b"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(drawn["hi"], 1) + 1))).cast("long")
        return _let(at, lambda j: F.struct(drawn["hi"].alias("hi"), drawn["lo"].alias("lo"), F.when(j < shards, j).otherwise(s["b"]).alias("b"), (j >= shards).alias("done")))

    step = lambda s, _: F.when(s["done"], s).otherwise(_let(_next(s["hi"], s["lo"]), lambda d: jump(s, d)))
    some = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(_AT_ONCE)), s, step)
    # the first draw always lands on 0, so that shards + 1 draws suffice; about ln(shards) are needed, and once a row is done whole runs are passed over
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards // _AT_ONCE)), start, lambda s, _: F.when(s["done"], s).otherwise(some(s)))["b"].cast("int")


def jump_shards(docs: DataFrame, shards: int = 16, blocks: int = 4096) -> DataFrame:
    """Deal documents to shards by doc_id.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law
    ("key"), shard, slot (from 0 without gaps in each shard) and grown_shard (the
    shard if there were one more).

    Slots are numbered within ``blocks`` hashed blocks of each shard, and blocks
    are offset by the counts of those before them: no shard is sorted in one task. The
    table of offsets has at most ``shards * blocks`` rows; with more shards there are
    fewer blocks, and with more than 65,536 shards it is not broadcast.
    """
    blocks = max(1, min(blocks, _OFFSETS // shards))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", jump_hash("doc_id", shards).alias("shard"), jump_hash("doc_id", shards + 1).alias("grown_shard"), (F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) % blocks).alias("block"))
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    offsets = F.broadcast(offsets) if shards * blocks <= _OFFSETS else offsets
    return rows.withColumn("inside", inside).join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("inside")).alias("slot"), "grown_shard")
