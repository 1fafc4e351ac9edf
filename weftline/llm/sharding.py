"""Sharding by jump consistent hashing, with built-in expressions only.

The generator is the published 64-bit linear congruential one; it runs here on three limbs (22, 22 and 20 bits)
because SQL arithmetic raises on overflow. A key's shard depends on the key and the shard count alone, so when a
shard is appended a row either stays or moves into the new shard.

Defined results: a null key counts as 0; a null text has size ``overhead`` and CRC 0; repeated rows get slots of
their own; an empty table gives an empty table; columns beyond those used are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import repeated, table, written

#: Fixed value: multiplier of the jump-hash generator.
MULTIPLIER = 2862933555777941757
LIMB = (1 << 22) - 1
TOP = (1 << 20) - 1
M0, M1, M2 = MULTIPLIER & LIMB, (MULTIPLIER >> 22) & LIMB, MULTIPLIER >> 44
N_SHARDS = 40
OVERHEAD = 16
#: Rows of a shard get their slots in this many independent pieces.
SLOT_PIECES = 64


def jump_shards(key: Column, n: int) -> Column:
    """struct(shard, grown): the shard of key among n shards and among n + 1.

    Each step moves to a bucket of a higher number, so n steps always suffice.
    """
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        k.bitwiseAND(LIMB).alias("a"), F.shiftrightunsigned(k, 22).bitwiseAND(LIMB).alias("b"), F.shiftrightunsigned(k, 44).alias("c"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next")
    )

    def step(s: Column) -> Column:
        r0 = s["a"] * F.lit(M0).cast("long") + 1
        r1 = s["a"] * F.lit(M1).cast("long") + s["b"] * F.lit(M0).cast("long") + F.shiftrightunsigned(r0, 22)
        r2 = s["a"] * F.lit(M2).cast("long") + s["b"] * F.lit(M1).cast("long") + s["c"] * F.lit(M0).cast("long") + F.shiftrightunsigned(r1, 22)
        b, c = r1.bitwiseAND(LIMB), r2.bitwiseAND(TOP)
        draw = c * 2048 + F.shiftrightunsigned(b, 11) + 1
        jump = ((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / draw.cast("double"))).cast("long")
        return F.struct(r0.bitwiseAND(LIMB).alias("a"), b.alias("b"), c.alias("c"), s["next"].alias("at"), jump.alias("next"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: F.when(s["next"] < n, step(s)).otherwise(s), lambda s: F.struct(s["at"].cast("int").alias("shard"), F.when(s["next"] == n, F.lit(n)).otherwise(s["at"].cast("int")).alias("grown")))
    return end


def shard(df: DataFrame, key: str = "doc_id", n_shards: int = N_SHARDS, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df with its shard among n_shards and among n_shards + 1; row by row, without a shuffle."""
    got = jump_shards(F.col(key), n_shards)
    return df.withColumn("__jump", got).withColumn(shard_col, F.col("__jump.shard")).withColumn(grown_col, F.col("__jump.grown")).drop("__jump")


def layout(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, overhead: int = OVERHEAD, pieces: int = SLOT_PIECES) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    Equal rows are counted before the shuffle, and slots are numbered in ``pieces`` parts of each shard, offset by
    the parts' totals, so neither a shard nor a group of copies is sorted in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col(key), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    thin = shard(thin, key, n_shards).withColumn("piece", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(pieces)).cast("int"))
    groups = written(thin.groupBy(key, "size", "text_crc32", "shard", "grown_shard", "piece").agg(F.count(F.lit(1)).alias("n")), "shards")
    totals = groups.groupBy("shard", "piece").agg(F.sum("n").alias("rows"))  # n_shards * pieces rows at most
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy(key, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.join(F.broadcast(offsets), ["shard", "piece"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return repeated(placed, "n", "copy").select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy") - 1).alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
