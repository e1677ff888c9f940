"""Helpers that the text operators share: tables, the held-out rule, checkpoints, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of all ids that no model may learn from; a null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_fields(frame: DataFrame, fields: str) -> StructType:
    """The schema of frame and these fields, all of them nullable."""
    own = [StructField(f.name, f.dataType, True) for f in frame.schema]
    return StructType([*own, *StructType.fromDDL(fields)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that the cluster shares."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, which a cluster's tasks share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def sample_by_hash(frame: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` rows (all if there are fewer), chosen by a hash of the key, the same rows in every run."""
    have = frame.count()
    if have <= bound:
        return frame
    share = int(bound / have * 2**31)
    return frame.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31)) < share)


#: What a model learns from, at most: texts of one key, characters of one text (its first ones), bytes of all texts.
KEY_ROWS = 4
LEARNED = 1 << 20
LEARN_BYTES = 1 << 27


def learning_texts(docs: DataFrame, chosen: DataFrame, key: str, text: str, bound: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the chosen (key, y), in the order of key and text: what a model on the driver learns from.

    Bounded in rows and bytes: of a key's different texts the KEY_ROWS first by hash, of a text its first LEARNED
    characters, and of all these, in the order of a hash, as many as LEARN_BYTES hold. So long texts
    teach like others, only fewer of them.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen.select(F.col(key).alias("k"), "y")), "k")
    rows = rows.filter(F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    rows = rows.groupBy("k", "h").agg(F.first(F.substring("t", 1, LEARNED)).alias("t"), F.max("y").alias("y"))
    few = checkpoint(rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("h"))).filter(F.col("n") <= KEY_ROWS))
    bytes_so_far = F.sum(F.col("size")).over(Window.orderBy("at", "k", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = few.select("k", "h", F.xxhash64("k", "h", F.lit("learn")).alias("at"), F.octet_length("t").cast("long").alias("size"))  # bound * KEY_ROWS rows
    kept = few.join(F.broadcast(sizes.withColumn("total", bytes_so_far).filter(F.col("total") <= LEARN_BYTES).select("k", "h")), ["k", "h"])
    got = sorted(((r.k, r.t, int(r.y)) for r in kept.select("k", "t", "y").collect()), key=lambda r: r[:2])
    return [r[1] for r in got], np.array([r[2] for r in got], np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014) over edges from a larger node
    to a smaller one: every round is two grouped minima and two joins, no node's neighbours meet in one
    task's memory, and the rounds grow with the logarithm of the longest path. The minima are checkpointed,
    so that each join has plain exchanges on both sides and Spark can split a node with very many
    neighbours. Self loops and repeated edges are allowed; no edges give no rows.
    """

    def minima(e: DataFrame) -> DataFrame:
        return checkpoint(e.groupBy("u").agg(F.min("v").alias("m")))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = mark(e)
    while before[0]:
        low = minima(e).withColumnRenamed("u", "x")
        large = e.join(low, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
        large = checkpoint(large.distinct())
        low = minima(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
