"""FASTA, FASTQ and alignment text as DataFrames that keep the order of records."""

from __future__ import annotations

import bz2
import glob
import gzip
import os
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.numbering import number_rows, saved
from .records import read_line_records

RECORD = "file string, ord bigint, name string, comment string, seq string, qual string"
#: Names of files that hold alignments, and reads.
ALIGNMENTS, READS = (".sam", ".bam"), (".fastq", ".fq", ".fastq.gz", ".fq.gz")


def open_text(path: str):
    if path.endswith(".gz"):
        return gzip.open(path, "rt")
    if path.endswith(".bz2"):
        return bz2.open(path, "rt")
    return open(path)


def parse_records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality) of FASTA and FASTQ records, also of several lines each."""
    name, seq, line = None, [], next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if line[:1] in (">", "@"):
            head = line[1:].split(None, 1)
            name, comment = (head[0] if head else ""), (head[1] if len(head) > 1 else "")
            seq, line = [], next(lines, None)
            while line is not None and line[:1] not in (">", "@", "+"):
                seq.append(line.strip())
                line = next(lines, None)
            text = "".join(seq)
            if line is None or line[:1] != "+":
                yield name, comment, text, None
                continue
            qual, size, line = [], 0, next(lines, None)
            while line is not None and size < len(text):
                qual.append(line.rstrip("\r\n"))
                size += len(qual[-1])
                line = next(lines, None)
            if size != len(text):
                raise ValueError(f"the quality of {name} is {size} letters long, not {len(text)}")
            yield name, comment, text, "".join(qual)
        else:
            line = next(lines, None)


def _paths(options: dict) -> list[str]:
    path = options.get("path", "")
    out = []
    for p in path.split(","):
        out += sorted(glob.glob(p)) if glob.has_magic(p) else sorted(glob.glob(f"{p}/*")) if os.path.isdir(p) else [p]
    return out


class _Files(DataSourceReader):
    """One partition for each file: records have no fixed size, and their order counts."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(p) for p in _paths(self.options)] or [InputPartition(None)]


class _SequenceReader(_Files):
    def read(self, partition):
        if partition.value is None:
            return
        with open_text(partition.value) as f:
            for i, (name, comment, seq, qual) in enumerate(parse_records(iter(f))):
                yield partition.value, i, name, comment, seq, qual


class SequenceSource(DataSource):
    """spark.read.format("sequences").load(path): FASTA or FASTQ, plain, gzip or bzip2."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema):
        return _SequenceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)


def _records(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )


def read_records(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    """(file, ord, line): lines, or other records, numbered from 0 in each file.

    Spark splits the files. Records are numbered within each split, and each split begins where the counts
    of the file's earlier ones end. There is one small row a split (of 128 MB by default), so 100 TB have fewer than
    a million, which are sent to every task.
    """
    rows = _records(spark, paths, separator)
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    begins = splits.select("file", "block", (_sum_before("n", "file") - F.col("first")).alias("shift"))
    # a split's places follow each other, so the shift of its split numbers a record; the text itself stays where it is
    return rows.join(F.broadcast(begins), ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("ord"), "line")


def _sum_before(n: str, *by: str):
    """The sum of n over the splits before, of all files or of each."""
    earlier = Window.partitionBy(*by).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0))


def _fasta_lines(spark: SparkSession, paths: list[str], number: str | None) -> DataFrame:
    """(file, ord, line) of FASTA records, without > before a name. With number also this column, from 1: the place of the
    record, among those that hold more than spaces, in all files; told by the counts of the splits, as `ord` is."""
    line = F.when(F.col("line").startswith(">"), F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line"))
    bare, filled = F.replace(line, F.lit("\r"), F.lit("")).alias("line"), "trim(line) <> ''"
    if number is None:
        return read_records(spark, paths, "\n>").select("file", "ord", bare).filter(filled)
    rows = _records(spark, paths, "\n>").select("file", "block", "place", bare)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.count_if(F.expr(filled)).alias("n_kept"))
    own = rows.filter(filled).withColumn("kept", F.monotonically_increasing_id())
    splits = saved(counts.join(own.groupBy("file", "block").agg(F.min("kept").alias("first_kept")), ["file", "block"], "left"))
    begins = splits.select("file", "block", (_sum_before("n", "file") - F.col("first")).alias("shift"), (_sum_before("n_kept") - F.col("first_kept") + 1).alias("shift_kept"))
    return own.join(F.broadcast(begins), ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("ord"), "line", (F.col("kept") + F.col("shift_kept")).alias(number))


def read_fasta(spark: SparkSession, *paths: str, number: str | None = None) -> DataFrame:
    """FASTA records, split where a line begins with >. With number also this column: the place of a record in all files, in
    the order of their names, from 1."""
    rows = _fasta_lines(spark, list(paths), number)
    head = F.substring_index("line", "\n", 1)
    body = F.replace(F.substring("line", F.length(head) + 2, F.length("line")), F.lit("\n"), F.lit(""))
    return rows.select(
        "file", "ord", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"),
        F.when(body.rlike(r"\s"), F.regexp_replace(body, r"\s", "")).otherwise(body).alias("seq"), F.lit(None).cast("string").alias("qual"),
        *([number] if number else []),
    )


def read_fastq(spark: SparkSession, *paths: str, number: str | None = None) -> DataFrame:
    """FASTQ records of any number of lines, split wherever Spark splits the files. With number also this column, as
    read_fasta tells it."""
    return read_line_records(spark, list(paths), number)


def read_sequences(spark: SparkSession, *paths: str, number: str | None = None) -> DataFrame:
    """Records of FASTA or FASTQ files, by the end of their names. With number also this column: the place of a record in
    all files, in the order of their names, from 1; files of both kinds together are dealt for it."""
    fastq = [p for p in paths if p.endswith(READS)]
    fasta = [p for p in paths if p not in fastq]
    kinds = [(f, own) for f, own in ((read_fasta, fasta), (read_fastq, fastq)) if own]
    if len(kinds) == 1:
        return kinds[0][0](spark, *kinds[0][1], number=number)
    both = reduce(DataFrame.unionByName, [f(spark, *own) for f, own in kinds])
    return number_rows(both, ["file", "ord"], number, start=1) if number else both


def read_contigs(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """(file, ord, contig_id, comment, seq, length), and number as read_sequences tells it."""
    rows = read_sequences(spark, path, number=number)
    return rows.select("file", "ord", F.col("name").alias("contig_id"), "comment", "seq", F.length("seq").alias("length"), *([number] if number else []))


def read_alignments(spark: SparkSession, *paths: str) -> DataFrame:
    """Alignment rows of text files, in their order; other text after the eleven columns is `tags`."""
    rows = read_records(spark, list(paths)).filter("line <> '' and substr(line, 1, 1) <> '@'")
    part = lambda i: F.try_element_at(F.col("p"), F.lit(i + 1))
    p = rows.withColumn("p", F.split("line", "\t", 12))
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [part(i).try_cast("int").alias(n) if n in ints else part(i).alias(n) for i, n in enumerate(names)]
    return p.select("file", "ord", *cols, F.coalesce(part(11), F.lit("")).alias("tags"))


def read_sam_header(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, contig_id, length) of the sequences in the headers."""
    lines = read_records(spark, list(paths)).filter(F.col("line").startswith("@SQ\t"))
    return lines.select("file", F.regexp_extract("line", r"\tSN:(\S+)", 1).alias("contig_id"), F.regexp_extract("line", r"\tLN:(\d+)", 1).cast("int").alias("length"))


def read_multiplicity(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, mult) of a table by commas, or by tabs if its name holds .tsv; empty barcodes are left
    out; of repeated ones the last counts."""
    sep = "\t" if ".tsv" in path else ","
    rows = read_records(spark, [path]).withColumn("p", F.split("line", sep))
    rows = rows.select("ord", F.col("p")[0].alias("barcode"), F.try_element_at("p", F.lit(2)).try_cast("int").alias("mult"))
    return rows.filter("barcode <> '' and mult is not null").groupBy("barcode").agg(F.max_by("mult", "ord").alias("mult"))


def read_fof(spark: SparkSession, path: str) -> list[str]:
    """Paths listed one a line, in a file wherever Spark reads files; in their order."""
    lines = read_records(spark, [path]).select("ord", F.trim("line").alias("line")).filter("line <> ''")
    names = [r["line"] for r in sorted(lines.collect(), key=lambda r: r["ord"])]
    if not names:
        raise ValueError(f"{path} lists no files")
    return names


def detect_format(paths: list[str]) -> str:
    """`alignments` or `reads` if all files are of one kind by the end of their names."""
    kinds = {"alignments" if p.endswith(ALIGNMENTS) else "reads" if p.endswith(READS) else "unknown" for p in paths}
    if len(kinds) != 1 or kinds == {"unknown"}:
        raise ValueError("all inputs must be alignments, or all reads")
    return kinds.pop()


def interleave(*frames: DataFrame) -> DataFrame:
    """Records of several files taken in turn, place by place, file by file; `place` is where each comes, from 0.

    Records are numbered once. Before the r-th of a file come r of every other file, or all where it has fewer, and the
    r-th of the files before it; so the counts of the files tell the place, and no record moves again.
    """
    numbered = [number_rows(f, ["ord"], "record") for f in frames]
    counts = [f.agg(F.count("*").alias(f"__n{i}")) for i, f in enumerate(numbered)]
    sizes = F.broadcast(reduce(DataFrame.crossJoin, counts))

    def placed(frame: DataFrame, i: int) -> DataFrame:
        before = [F.least(F.col("record") + (1 if j < i else 0), F.col(f"__n{j}")) for j in range(len(frames)) if j != i]
        place = sum(before, F.col("record")).cast("long").alias("place")
        return frame.crossJoin(sizes).select(*frames[i].columns, F.lit(i).alias("file_no"), place)

    return reduce(DataFrame.unionByName, [placed(f, i) for i, f in enumerate(numbered)])


def fasta_index(contigs: DataFrame, line: int = 60) -> DataFrame:
    """(contig_id, length, begin): where each contig begins if all are put end to end, in file order.

    Contigs are dealt by ranges of their place; the lengths of the ranges before begin a range, so no file meets in one task.
    """
    n = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(contigs.select("file", "ord", "contig_id", "length").repartitionByRange(n, "file", "ord").withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("file", "__range").agg(F.sum("length").alias("__sum"))
    earlier = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("file", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__begin"))
    within = F.sum("length").over(Window.partitionBy("file", "__range").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("__within", F.coalesce(within, F.lit(0))).join(begins, ["file", "__range"])
    return placed.select("file", "ord", "contig_id", "length", (F.col("__begin") + F.col("__within")).alias("begin"))
