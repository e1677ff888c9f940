"""Column functions over read names, tags and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bx_from_tags(tags: Column) -> Column:
    """The barcode of alignment tags: after the first BX:Z: up to white space; '' if there is none."""
    return F.coalesce(F.regexp_extract(tags, r"BX:Z:([^ \t\r\n]*)", 1), F.lit(""))


def bx_from_comment(comment: Column) -> Column:
    """The barcode of a read comment: after the first BX:Z: up to a space (a tab stays in it)."""
    return F.coalesce(F.regexp_extract(comment, r"BX:Z:([^ ]*)", 1), F.lit(""))


def barcode_from_name(name: Column) -> Column:
    """What follows the last underscore of a read name, if it is all bases; else ''."""
    return F.coalesce(F.regexp_extract(name, r"_([ACGTacgt]*)$", 1), F.lit(""))


def barcode(tags: Column, name: Column) -> Column:
    """The barcode of an alignment, by its tag or else by its read's name; null if it has none."""
    return F.coalesce(_or_null(bx_from_tags(tags)), _or_null(barcode_from_name(name)))


def strip_read_num(name: Column) -> Column:
    """Without the last slash and what follows it, if a digit follows."""
    return F.regexp_replace(name, r"/[0-9][^/]*$", "")


def seq_identity(cigar: Column, tags: Column, seq: Column) -> Column:
    """Per cent of a read's letters that are aligned and no edit, cut to a whole number; 0 if none are aligned."""
    aligned = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[M=XI]"), F.lit(1)), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0)))
    edits = F.coalesce(F.regexp_extract(tags, r"NM:i:(\d+)", 1).try_cast("int"), F.lit(0))
    share = (aligned - edits).cast("double") / F.nullif(F.length(seq), F.lit(0)) * 100
    return F.when(aligned == 0, F.lit(0)).otherwise(F.coalesce(share.cast("int"), F.lit(0)))


def pair_mid_pos(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2).cast("int")


def proper_flag(flag: Column) -> Column:
    """Proper pair, mates inward; first or second of the pair."""
    return flag.bitwiseAND(~192).isin(19, 35)


def primary_flag(flag: Column) -> Column:
    return flag.bitwiseAND(0x900) == 0


def end_cutoff(size: Column, end_length: int) -> Column:
    """How much of a contig each of its ends takes: end_length, or half if the contig is short."""
    if end_length == 0:
        return F.floor(size / 2).cast("int")
    return F.when(size <= 2 * end_length, F.floor(size / 2).cast("int")).otherwise(F.lit(end_length))


def is_head_by_position(position: Column, size: Column, end_length: int) -> Column:
    """True in the head, False in the tail, null in the middle."""
    cut = end_cutoff(size, end_length)
    return F.when(position <= cut, F.lit(True)).when(position > size - cut, F.lit(False))
