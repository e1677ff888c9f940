"""Alignment mode: read pairs on contig ends from alignment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.tags import barcode, is_head_by_position, pair_mid_pos, primary_flag, proper_flag, seq_identity
from .numbering import saved
from .pairs import barcode_multiplicity, end_counts


def with_barcodes(alignments: DataFrame) -> DataFrame:
    return alignments.withColumns({"barcode": barcode(F.col("tags"), F.col("qname")), "identity": seq_identity(F.col("cigar"), F.col("tags"), F.col("seq"))})


def alignment_multiplicity(alignments: DataFrame) -> DataFrame:
    """Primary records of each barcode, unmapped ones too."""
    return barcode_multiplicity(alignments.filter(primary_flag(F.col("flag"))))


#: Places of one file that are looked at together when mates are joined.
STRETCH = 1 << 17


def join_mates(alignments: DataFrame, compat: bool = True, key: str = "qname") -> DataFrame:
    """Runs of exactly two neighbouring records with one name, as structs `first` and `second` in record order.

    A name that recurs later in the file begins a new run, runs of three and more records give nothing. compat leaves
    out a run that ends its file, whose pair is never completed in a reader that adds a pair when it meets the
    next name.

    Files are cut into stretches of STRETCH places, whose records find their neighbours (one before, two after) in a
    window. Of each stretch the three first and last names, with the records, meet in a window over the whole file
    too, which so holds six rows a stretch at most and tells the neighbours over the cuts. Places need not be gapless.
    """
    fields = [c for c in alignments.columns if c not in ("file", key)]
    rows = alignments.select("file", F.col(key).alias("__name"), F.struct(*fields).alias("first"), F.col("ord").alias("__ord"), F.floor(F.col("ord") / STRETCH).alias("__stretch"))
    place = Window.partitionBy("file", "__stretch").orderBy("__ord")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = _neighbours(rows, place).withColumns({"__at": F.row_number().over(place), "__back": F.count("*").over(whole) - F.row_number().over(place) + 1})
    near = saved(near.filter(((F.col("__at") <= 3) | (F.col("__back") <= 3)) | _is_pair(compat)))
    inner = near.filter((F.col("__at") > 1) & (F.col("__back") > 2))
    ends = near.filter((F.col("__at") <= 3) | (F.col("__back") <= 3)).select(*rows.columns, "__at", "__back")
    cut = _neighbours(ends, Window.partitionBy("file").orderBy("__ord")).filter((F.col("__at") == 1) | (F.col("__back") <= 2))
    both = inner.unionByName(cut).filter(_is_pair(compat))
    return both.select("file", F.col("__name").alias(key), "first", "second")


def _neighbours(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """rows with the names around a record, and the next record; the names are structs, as null is a name too."""
    name = F.struct("__name")
    return rows.withColumns(
        {"__before": F.lag(name).over(order), "__next": F.lead(name).over(order), "__then": F.lead(name, 2).over(order), "second": F.lead("first").over(order)}
    )


def _is_pair(compat: bool) -> Column:
    own = F.struct("__name")
    pair = own.eqNullSafe(F.col("__next")) & ~own.eqNullSafe(F.col("__before")) & ~own.eqNullSafe(F.col("__then"))
    return pair & F.col("__then").isNotNull() if compat else pair


def mate_columns(alignments: DataFrame) -> DataFrame:
    """What good_pairs looks at, so that no sequences, qualities and tags are shuffled: of seq its first letter."""
    return alignments.select("file", "ord", "qname", "flag", "mapq", "identity", "rname", "pos", "barcode", F.substring("seq", 1, 1).alias("seq"))


def good_pairs(mates: DataFrame, seq_id: int) -> DataFrame:
    """(barcode, contig, mid_pos) of pairs in which both mates are proper, unique, similar enough and on
    the same contig; the barcode is the second mate's."""
    a, b = (lambda c: F.col(f"first.{c}")), (lambda c: F.col(f"second.{c}"))
    good = proper_flag(a("flag")) & proper_flag(b("flag")) & (a("mapq") != 0) & (b("mapq") != 0)
    good &= (a("identity") >= seq_id) & (b("identity") >= seq_id) & (F.length(b("seq")) > 0)
    good &= (a("rname") == b("rname")) & ~b("rname").isin("*", "") & b("barcode").isNotNull()
    return mates.filter(good).select(b("barcode").alias("barcode"), b("rname").alias("contig"), pair_mid_pos(a("pos"), b("pos")).alias("mid_pos"))


def alignment_end_counts(pairs: DataFrame, lengths: DataFrame, min_size: int, end_length: int) -> DataFrame:
    """(barcode, contig, is_head, n) of pairs near the ends of contigs that are long enough."""
    sized = pairs.join(lengths.filter(F.col("length") >= min_size), "contig")
    return end_counts(sized.withColumn("is_head", is_head_by_position(F.col("mid_pos"), F.col("length"), end_length)))
