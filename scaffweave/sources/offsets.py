"""Byte offsets of sequences in FASTA files: the index of a file, its text, and offsets looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import saved, sums_before


def offset_index(lines: DataFrame) -> DataFrame:
    """(file, ord, contig_id, size, offset) of lines (file, ord, line) of FASTA with one line of sequence a record: the
    bytes of the sequence and where they begin. Lines end with one byte. ord counts records from 0.

    A sequence of a second line, or one before any header, raises.
    """
    placed = sums_before(lines, (F.octet_length("line") + 1).cast("long"), ["file"], ["ord"], "__at")
    is_head = F.col("line").startswith(">")
    # a record is a header line and the line after it; their numbers in the file differ by one
    seq = placed.filter(~is_head & (F.col("line") != "")).select("file", (F.col("ord") - 1).alias("ord"), F.octet_length("line").alias("size"), F.col("__at").alias("offset"))
    heads = placed.filter(is_head).select("file", "ord", F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig_id"), (F.col("__at") + F.octet_length("line") + 1).alias("__after"))
    both = heads.join(seq, ["file", "ord"], "full")
    stray = F.raise_error(F.concat(F.lit("a line of "), F.col("file"), F.lit(" is no header's only sequence line")))
    both = both.withColumn("contig_id", F.when(F.col("contig_id").isNull(), stray).otherwise(F.col("contig_id")))
    rows = both.select("file", "ord", "contig_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("offset", "__after").cast("long").alias("offset"))
    return sums_before(rows, F.lit(1).cast("long"), ["file"], ["ord"], "__record").withColumn("ord", F.col("__record").cast("long")).drop("__record")


def fai_lines(index: DataFrame) -> DataFrame:
    """(file, ord, value): the index as text, with the size as the letters and one more as the bytes of a line."""
    return index.select("file", "ord", F.concat_ws("\t", "contig_id", "size", "offset", "size", F.col("size") + 1).alias("value"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, contig_id, size, offset) of an index as text; records of several lines of sequence raise."""
    from .sequences import read_records

    p = F.split("line", "\t")
    rows = read_records(spark, [path]).filter("line <> ''").select("file", "ord", p[0].alias("contig_id"), *[p[i].cast("long").alias(n) for i, n in ((1, "size"), (2, "offset"), (3, "letters"), (4, "bytes"))])
    wrong = (F.col("size") != F.col("letters")) & (F.col("letters") != F.col("bytes"))
    return rows.withColumn("size", F.when(wrong, F.raise_error(F.concat(F.col("contig_id"), F.lit(" has several lines")))).otherwise(F.col("size"))).drop("letters", "bytes")


def sam_header_lines(index: DataFrame) -> DataFrame:
    """(file, ord, value): a header line of alignment text for each sequence."""
    return index.select("file", "ord", F.concat(F.lit("@SQ\tSN:"), F.col("contig_id"), F.lit("\tLN:"), F.col("size")).alias("value"))


def locate(index: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (file, offset, ...) with contig_id and position, null where an offset lies in no sequence.

    A range join: different offsets and the index are dealt together by ranges of file and offset; each offset takes
    the last record before it in its range, or the last of the ranges before, of which there is one row a range.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    record = F.struct("contig_id", "size", F.col("offset").alias("begin"))
    none = F.lit(None).cast("struct<contig_id: string, size: long, begin: long>")
    marks = index.select("file", F.col("offset").cast("long").alias("offset"), F.lit(0).alias("__asks"), record.cast("struct<contig_id: string, size: long, begin: long>").alias("__record"))
    asks = offsets.select("file", F.col("offset").cast("long").alias("offset")).filter("offset is not null").distinct().select("*", F.lit(1).alias("__asks"), none.alias("__record"))
    both = saved(marks.unionByName(asks).repartitionByRange(n, "file", "offset").withColumn("__range", F.spark_partition_id()))
    last = F.last("__record", ignorenulls=True)
    carried = both.groupBy("file", "__range").agg(F.max_by("__record", F.when(F.col("__asks") == 0, F.col("offset"))).alias("__last"))
    earlier = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("file", "__range", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    own = last.over(Window.partitionBy("file", "__range").orderBy("offset", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("__own", own).filter("__asks = 1").join(carried, ["file", "__range"])
    r = F.coalesce("__own", "__carried")
    at = F.col("offset") - r["begin"]
    inside = found.select("file", "offset", r["contig_id"].alias("contig_id"), at.alias("position"), (at < r["size"]).alias("__inside")).filter("__inside").drop("__inside")
    return offsets.join(inside, ["file", "offset"], "left")
