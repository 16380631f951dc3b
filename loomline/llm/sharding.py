"""Shards by jump consistent hashing, in DataFrame expressions only.

A key's candidate shard jumps ahead by pseudo-random steps until the next jump
would leave the shards there are; the shard is where it last landed.  No ring or
table is kept, and with one more shard a row either stays or goes to the new one.
The steps' random numbers are 31 bits of xxhash64(key, step).  A jump moves ahead
by one shard at least, so as many steps as shards always end; the few first ones
nearly always do, and the others are evaluated only where they didn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps tried for every row before the rest of them, for rows that need it.
FIRST = 10
#: Parts of a shard whose rows are numbered apart; a count for each part of each shard is broadcast.
PARTS = 256


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of ``key``, 0 to shards - 1; null keys are one key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, i: Column) -> Column:
        # uniform in (0, 1]
        u = (F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1).cast("double") / F.lit(float(1 << 31))
        # a jump beyond any number of shards ends as well as one just beyond them
        ahead = F.least(F.floor((s["j"] + 1).cast("double") / u), F.lit(1 << 40)).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), ahead.alias("j")))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(FIRST, shards))), state, step)
    if shards <= FIRST:
        return first["b"].cast("int")
    # nested, so that the first steps are evaluated once
    more = F.aggregate(
        F.array(first), F.lit(0).cast("long"),
        lambda _, s: F.when(s["j"] >= shards, s["b"]).otherwise(F.aggregate(F.sequence(F.lit(FIRST + 1), F.lit(shards)), s, step)["b"]),
    )
    return more.cast("int")


def shard(docs: DataFrame, shards: int, key_col: str = "doc_id", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``docs`` to one row per row: key_col, the columns of ``keep``, shard, slot, grown_shard.

    shard depends on the key and the number of shards alone; grown_shard is the
    shard with one more, which is the same or the new one.  slot numbers the rows of
    a shard from 0 without a gap, in the order of parts and, in a part, of the key
    and ``keep``; rows that are equal in all of these are numbered in any order.

    Rows that repeat a key share its shard, rows without a key those of one key.
    An empty table gives an empty result; other columns are ignored.
    """
    key = F.col("__key")
    part = F.pmod(F.xxhash64(key, F.lit(-7)), F.lit(PARTS)).cast("int")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": jump_shard(key, shards), "__part": part})

    extra = [f"__c{i}" for i in range(len(keep))]
    counts = placed(docs.select(F.col(key_col).alias("__key"))).groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    # shards x PARTS rows at most
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).drop("__n")
    rows = placed(docs.select(F.col(key_col).alias("__key"), *(c.alias(n) for c, n in zip(keep, extra))))
    small = shards * PARTS <= 1 << 20
    numbered = rows.withColumn("__at", F.row_number().over(W.partitionBy("shard", "__part").orderBy("__key", *extra)) - 1)
    out = numbered.join(F.broadcast(before) if small else before, ["shard", "__part"])
    return out.select(
        F.col("__key").alias(key_col), *(F.col(n) for n in extra), "shard",
        (F.coalesce("__before", F.lit(0)) + F.col("__at")).cast("long").alias("slot"), jump_shard(key, shards + 1).alias("grown_shard"),
    )


def op7_jump_hash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    out = shard(docs, 40, keep=(size, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return out.select("doc_id", F.col("__c0").alias("size"), F.col("__c1").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
