"""Rendezvous hashing of records over weighted shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import partitions


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the best score for the key.

    A shard scores -weight / ln(u) with u in (0, 1) from a hash of key and shard alone, so shards win
    records in proportion to their weights, and a new shard takes records only into itself. Equal keys
    share a shard; null is a key of its own; equal scores go to the higher shard.
    """

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11).cast("double")
        return F.lit(-float(weight)) / F.ln((bits + 0.5) / float(2**53))

    ranked = [F.struct(score(i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*ranked))["shard"]


def slot_bucket(key: Column, size: Column, crc: Column, buckets: int) -> Column:
    """The bucket that a row is numbered in."""
    return F.pmod(F.xxhash64(F.lit("bucket"), key, size, crc), F.lit(buckets)).cast("int")


def assign_shards(
    docs: DataFrame, shards: int = 24, weights: list[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 (null text: 8, crc32 0). slot counts a shard's documents
    gaplessly from 0: rows are numbered within (shard, bucket of a hash of key, size and crc32), and each bucket
    starts where the counts of the shard's earlier buckets end; so neither a shard nor a key of very many rows,
    like null, passes through one task (rows equal in all three do). grown_shard is the shard if there were one
    more (with the mean weight). Repeated keys stay together and get slots of their own; an empty table gives
    no rows; other columns are ignored.
    """
    weights = weights or [1.0] * shards
    buckets = 4 * partitions(docs.sparkSession)
    measured = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    placed = measured.withColumn("bucket", slot_bucket(F.col(key), F.col("size"), F.col("text_crc32"), buckets))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "bucket").orderBy(key, "size", "text_crc32")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(begins, ["shard", "bucket"])
        .select(
            key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
