"""Graph files as DataFrames of vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _attribute(name: str):
    return F.nullif(F.regexp_extract("value", rf"[\[,\s]{name}=\"?([^,\]\s\"]+)", 1), F.lit(""))


def read_gv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(idx, id) and (a, b, label, weight, d) of an undirected scaffold graph file."""
    lines = spark.read.text(path)
    nodes = lines.filter(F.col("value").rlike(r"^\s*\d+\s*\[id=")).select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("idx"), _attribute("id").alias("id"))
    edges = lines.filter(F.col("value").rlike(r"^\s*\d+--\d+")).select(
        F.regexp_extract("value", r"^\s*(\d+)--", 1).cast("long").alias("a"), F.regexp_extract("value", r"--(\d+)", 1).cast("long").alias("b"),
        _attribute("label").cast("int").alias("label"), _attribute("weight").cast("int").alias("weight"), _attribute("d").cast("int").alias("d"),
    )
    return nodes, edges


def gv_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, orientation, weight, dist) by contig names."""
    name = lambda c, n: nodes.select(F.col("idx").alias(c), F.col("id").alias(n))
    return edges.join(name("a", "u"), "a").join(name("b", "v"), "b").select("u", "v", F.col("label").alias("orientation"), "weight", F.col("d").alias("dist"))


def read_dist_gv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, strand, length) and (src, src_strand, dst, dst_strand, d, e, n) of a distance graph file."""
    lines = spark.read.text(path)
    end = r'"([^"]+)([+-])"'
    nodes = lines.filter(F.col("value").rlike(rf"^{end} \[l=")).select(
        F.regexp_extract("value", end, 1).alias("id"), F.regexp_extract("value", end, 2).alias("strand"), _attribute("l").cast("int").alias("length")
    )
    both = rf"^{end} -> {end}"
    edges = lines.filter(F.col("value").rlike(both)).select(
        *[F.regexp_extract("value", both, i).alias(n) for i, n in enumerate(("src", "src_strand", "dst", "dst_strand"), 1)],
        _attribute("d").cast("int").alias("d"), _attribute("e").cast("double").alias("e"), _attribute("n").cast("int").alias("n"),
    )
    return nodes, edges
