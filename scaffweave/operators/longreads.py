"""Long reads cut into pseudo-linked read pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.sequence import reverse_complement
from .numbering import number_rows


def long_enough(reads: DataFrame, cut: int, min_length: int = 0) -> DataFrame:
    return reads.filter(F.length("seq") >= max(2 * cut, min_length))


#: Letters of the mates that are handed on at once.
AT_ONCE = 1 << 23


def _pieces(n: int, cut: int) -> tuple[list[int], list[int], list[int]]:
    """Where the first and second mates of a read of n letters begin, and their sizes."""
    whole, rest = divmod(n, 2 * cut)
    first, size = [i * 2 * cut for i in range(whole)], [cut] * whole
    second = [x + cut for x in first]
    if rest:
        size.append(min(cut, rest))
        first.append(n - rest)
        second.append(n - size[-1])
    return first, second, size


def cut_long_reads(reads: DataFrame, cut: int, min_length: int = 0, barcode: str = "barcode", fasta: bool = False) -> DataFrame:
    """(name, barcode, read_num, fwd, rev, fwd_qual, rev_qual): a pair for every 2 * cut letters of a read,
    and one for the rest at its end (whose mates overlap if the rest is no longer than a mate).

    Mates are cut out of the read where it lies, in time that grows with its length alone."""
    kept = [c for c in ("name", barcode) if c in reads.columns]
    least = max(2 * cut, min_length)
    texts = ["seq", *["qual"] * ("qual" in reads.columns and not fasta)]
    mates = [f"{t}_{m}" for t in texts for m in ("first", "second")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, cuts, held = [], [], [[] for _ in mates], 0
            for i in range(batch.num_rows):
                own = [batch.column(t)[i].as_py() for t in texts]
                # told here, as a filter below would work the sequence out anew where it is an expression
                own[0] = own[0] or ""
                first, second, size = _pieces(len(own[0]), cut) if len(own[0]) >= least else ([], [], [])
                for t, text in enumerate(own):
                    for out, starts in ((cuts[2 * t], first), (cuts[2 * t + 1], second)):
                        out.extend([text[a : a + z] for a, z in zip(starts, size, strict=True)] if text else [None] * len(size))
                row.extend([i] * len(size))
                number.extend(range(len(size)))
                held += len(own[0])
                if held >= AT_ONCE or i == batch.num_rows - 1:
                    at = pa.array(row, pa.int64())
                    columns = [*(c.take(at) for c in batch.columns[len(texts) :]), pa.array(number, pa.int32()), *(pa.array(c, pa.string()) for c in cuts)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "read_num", *mates])
                    row, number, cuts, held = [], [], [[] for _ in mates], 0

    own = [StructField(f.name, f.dataType, True) for f in reads.select(*kept).schema]
    shape = StructType([*own, StructField("read_num", IntegerType(), True), *[StructField(m, StringType(), True) for m in mates]])
    rows = reads.select(*texts, *kept).mapInArrow(pieces, shape)
    out = [*kept, "read_num", F.col("seq_first").alias("fwd"), reverse_complement(F.col("seq_second")).alias("rev")]
    if not fasta:
        qual = lambda m: F.coalesce(F.col(f"qual_{m}") if "qual" in texts else F.lit(None), F.repeat(F.lit("#"), F.length(f"seq_{m}")))
        out += [qual("first").alias("fwd_qual"), F.reverse(qual("second")).alias("rev_qual")]
    return rows.select(*out)


def long_read_barcodes(reads: DataFrame, order: list[str] | None = None) -> DataFrame:
    """reads with barcode, the place of the record in all files, from 1."""
    return number_rows(reads, order or ["file", "ord"], "barcode", start=1)


def pseudo_multiplicity(reads: DataFrame, cut: int, min_length: int = 0) -> DataFrame:
    """(barcode, n): the pseudo reads of each long read, from its length alone."""
    n, step = F.length("seq"), 2 * cut
    mult = F.when(n % step != 0, (F.floor(n / step) + 1) * 2).otherwise(F.floor(n / cut))
    return long_enough(reads, cut, min_length).select("barcode", mult.cast("long").alias("n"))


def span(reads: DataFrame, genome_size: int, coverage_share: float) -> DataFrame:
    """One row, the span parameter: whole genomes that all reads together make, times the share."""
    return reads.agg(F.floor(F.floor(F.coalesce(F.sum(F.length("seq")), F.lit(0)) / genome_size) * F.lit(float(coverage_share))).cast("long").alias("span"))


def length_percentile(reads: DataFrame, p: float, over: int = 1000) -> DataFrame:
    """One row: the p-th percentile of the lengths over the bound; the mean of two neighbours at whole places.

    Counts of each length are summed up in the order of lengths, so what meets in one task is as long as
    the longest read at most, not as the table.
    """
    from pyspark.sql import Window

    lengths = reads.select(F.length("seq").alias("len")).filter(F.col("len") > over).groupBy("len").agg(F.count("*").alias("n"))
    upto = lengths.select("len", "n", F.sum("n").over(Window.orderBy("len")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    place = F.col("total") * F.lit(float(p) / 100)
    upper = F.least(F.floor(place), F.col("total") - 1)
    lower = F.when(place == F.floor(place), F.greatest(F.floor(place) - 1, F.lit(0))).otherwise(upper)
    at = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (i < F.col("upto")), F.col("len")))
    return upto.agg(at(lower).alias("a"), at(upper).alias("b")).select(F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias(f"read_p{p:g}"))
