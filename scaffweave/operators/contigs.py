"""Contigs and their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import is_valid_contig
from ..functions.tags import end_cutoff
from .numbering import number_rows


def contig_lengths(contigs: DataFrame) -> DataFrame:
    """(contig, length); of records that repeat an id the last counts."""
    return contigs.groupBy(F.col("contig_id").alias("contig")).agg(F.max_by(F.length("seq"), F.struct("file", "ord")).alias("length"))


def count_valid_contigs(contigs: DataFrame, min_size: int) -> DataFrame:
    """One row: contigs of min_size letters at least that are all IUPAC, and the end slots that they need."""
    n = F.count_if((F.length("seq") >= min_size) & is_valid_contig(F.col("seq")))
    return contigs.agg(n.alias("n_contigs"), (n * 2 + 1).alias("n_slots"))


def rename_contigs(contigs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """contigs with their ids replaced by their place, from 1."""
    return number_rows(contigs, order or ["file", "ord"], "place", start=1).withColumn("contig_id", F.col("place").cast("string")).drop("place")


def contig_ends(contigs: DataFrame, min_size: int, end_length: int, order: list[str] | None = None) -> DataFrame:
    """(end_idx, contig, is_head, end_seq) of contigs that are long enough; the i-th has ends 2i-1 and 2i."""
    order = order or ["file", "ord"]
    cut = end_cutoff(F.length("seq"), end_length)
    # cut before they are numbered, so that no more than the ends is dealt
    ends = contigs.filter(F.length("seq") >= min_size).select(*order, F.col("contig_id").alias("__contig"), F.substring("seq", F.lit(1), cut).alias("__head"), F.right("seq", cut).alias("__tail"))
    kept = number_rows(ends, order, "place", start=1)
    head = F.struct((F.col("place") * 2 - 1).alias("end_idx"), F.lit(True).alias("is_head"), F.col("__head").alias("end_seq"))
    tail = F.struct((F.col("place") * 2).alias("end_idx"), F.lit(False).alias("is_head"), F.col("__tail").alias("end_seq"))
    rows = kept.select(F.col("__contig").alias("contig"), F.explode(F.array(head, tail)).alias("end"))
    return rows.select("end.end_idx", "contig", "end.is_head", "end.end_seq")


def validate_header(header: DataFrame, lengths: DataFrame) -> None:
    """Raises if an alignment header names an unknown contig, or another length or none."""
    known = lengths.select(F.col("contig").alias("contig_id"), F.col("length").alias("known"))
    bad = header.join(known, "contig_id", "left").filter("known is null or not known <=> length").limit(1).collect()
    if bad:
        row = bad[0]
        raise ValueError(f"unexpected sequence {row['contig_id']} of length {row['length']} (known: {row['known']})")
