"""Domain tables that Spark derives from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END, SIZE = 20, 50
LOW, HIGH = 550, 650
MIN_READS = 5
#: The normal quantiles of one-sided error rates 0.05 and 0.3.
Z05, Z30 = 1.6448536269514722, 0.5244005127080407


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(barcode, contig, position): suppliers as barcodes, brands as contigs, quantities as positions."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_suppkey").cast("string").alias("barcode"), F.col("p_brand").alias("contig"), F.col("l_quantity").cast("int").alias("position"))


def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("barcode")).agg(F.count("*").alias("mult"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, length): two ends and as much between them as the brand's number."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("contig")).distinct()
    return brands.withColumn("length", (2 * END + F.regexp_extract("contig", r"(\d+)", 1).cast("int")))


_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def bases(text) -> "F.Column":
    """Letters as bases; all else but spaces left out."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z ]", ""), _LETTERS, _BASES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ord, name, seq) of the documents as sequences with spaces as breaks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("documents").alias("file"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("name"), "doc_id", bases(F.col("text")).alias("seq"))


def solid_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir)
    return rows.withColumn("seq", F.replace("seq", F.lit(" "), F.lit("")))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows made from events: three neighbouring ids share a name now and then."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.lit("events").alias("file"), i.alias("ord"), F.floor((i - F.when(i % 7 == 0, 1).otherwise(0)) / 2).cast("string").alias("qname"),
        F.when(F.col("value") > 100, 97).otherwise(F.when(i % 2 == 0, 99).otherwise(147)).cast("int").alias("flag"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("rname"),
        (F.floor(F.col("value")) % 400 + 1).cast("int").alias("pos"), F.when(F.col("value") < 20, 0).otherwise(60).cast("int").alias("mapq"),
        F.concat((i % 10).cast("string"), F.lit("S"), (F.lit(100) - i % 10).cast("string"), F.lit("M")).alias("cigar"), F.lit("=").alias("rnext"),
        F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.repeat(F.lit("A"), F.lit(100)).alias("seq"), F.lit("*").alias("qual"),
        F.concat(F.lit("NM:i:"), (i % 4).cast("string"), F.lit("\tBX:Z:"), F.floor(F.col("user_id") / 3).cast("string"), F.lit("-1")).alias("tags"),
    )


def recurring_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows in two files whose names come again: runs of one to four records, names of users by turns."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    run = F.floor((i + F.when(i % 11 < 4, i % 2).otherwise(0)) / 2)
    return e.select(
        F.when(i % 5000 < 3000, F.lit("a")).otherwise(F.lit("b")).alias("file"), (2 * i + F.when(i % 13 == 0, 1).otherwise(0)).alias("ord"), (run % 97).cast("string").alias("qname"),
        (F.floor(F.col("value")) % 400 + 1).cast("int").alias("pos"), "event_id",
    )
