"""From barcodes on contig ends to oriented contig pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import sense_sign
from ..functions.stats import significant

COUNTS = ["hh", "ht", "th", "tt"]


def barcode_multiplicity(reads: DataFrame, barcode: str = "barcode") -> DataFrame:
    """(barcode, mult): reads of each barcode; null and empty ones are left out."""
    return reads.filter(F.col(barcode).isNotNull() & (F.col(barcode) != "")).groupBy(F.col(barcode).alias("barcode")).agg(F.count("*").alias("mult"))


def end_counts(hits: DataFrame) -> DataFrame:
    """(barcode, contig, is_head, n) of rows (barcode, contig, is_head); null ends (the middle) are left out."""
    return hits.filter("is_head is not null").groupBy("barcode", "contig", "is_head").agg(F.count("*").alias("n"))


def in_multiplicity_range(imap: DataFrame, mult: DataFrame, low: int, high: int) -> DataFrame:
    """Rows whose barcode has a multiplicity in the inclusive range."""
    return imap.join(mult.filter(F.col("mult").between(low, high)).select("barcode"), "barcode", "left_semi")


def heads_and_tails(imap: DataFrame) -> DataFrame:
    """(barcode, contig, head, tail), 0 for an end with no reads."""
    n = lambda head: F.coalesce(F.sum(F.when(F.col("is_head") == head, F.col("n"))), F.lit(0)).alias("head" if head else "tail")
    return imap.groupBy("barcode", "contig").agg(n(True), n(False))


def head_or_tail(imap: DataFrame, min_reads: int, z: float) -> DataFrame:
    """Contigs of a barcode whose reads lie at one end significantly: (barcode, contig, head, tail, is_head)."""
    most, total = F.greatest("head", "tail"), F.col("head") + F.col("tail")
    kept = heads_and_tails(imap).filter((total >= min_reads) & significant(most, total, z))
    return kept.withColumn("is_head", F.col("head") >= F.col("tail"))


def pair_orientations(ends: DataFrame) -> DataFrame:
    """(u, v, hh, ht, th, tt): barcodes that two contigs (u < v) share, by their ends.

    A self-join of the significant ends on the barcode; the test before it keeps the join small, and
    Spark splits a barcode that is skewed. A barcode has a contig once, so a pair once.
    """
    a = ends.select("barcode", F.col("contig").alias("u"), F.col("is_head").alias("u_head"))
    b = ends.select("barcode", F.col("contig").alias("v"), F.col("is_head").alias("v_head"))
    both = a.join(b, "barcode").filter("u < v")
    return both.groupBy("u", "v").agg(
        *[
            F.count_if((F.col("u_head") == (name[0] == "h")) & (F.col("v_head") == (name[1] == "h"))).alias(name)
            for name in COUNTS
        ]
    )


def count_barcodes(imap: DataFrame, mult: DataFrame, low: int, high: int) -> DataFrame:
    """One row: all barcodes, those in range, those on contig ends."""
    none = F.lit(None).cast("long")
    a = mult.select(F.count("*").alias("all_unfiltered"), F.count_if(F.col("mult").between(low, high)).alias("all_filtered"), none.alias("scaffold_end"))
    b = imap.select(none.alias("all_unfiltered"), none.alias("all_filtered"), F.count_distinct("barcode").alias("scaffold_end"))
    return a.unionByName(b).agg(*[F.max(c).alias(c) for c in a.columns])


def barcodes_per_end(imap: DataFrame, min_reads: int) -> DataFrame:
    """(contig, is_head, barcodes): barcodes with enough reads at the end."""
    return imap.filter(F.col("n") >= min_reads).groupBy("contig", "is_head").agg(F.count("*").alias("barcodes"))


def unpivot_pairs(pairs: DataFrame) -> DataFrame:
    """(u, v, orientation, shared, most): a row for each orientation that has barcodes."""
    rows = F.array(*[F.struct(F.lit(i).alias("orientation"), F.col(c).alias("shared")) for i, c in enumerate(COUNTS)])
    long = pairs.select("u", "v", F.greatest(*COUNTS).alias("most"), F.explode(rows).alias("r"))
    return long.select("u", "v", "r.orientation", "r.shared", "most").filter("shared > 0")


def mirrored(frame: DataFrame, swap: dict[str, tuple[Column, Column]], same: list[str]) -> DataFrame:
    """Each row twice: with the first of each pair of expressions, and with the second."""
    rows = F.array(*[F.struct(*[pair[i].alias(name) for name, pair in swap.items()]) for i in (0, 1)])
    return frame.select(*same, F.explode(rows).alias("__m")).select(*[f"__m.{name}" for name in swap], *same)


def pair_table(pairs: DataFrame, imap: DataFrame, min_reads: int, all_barcodes: int | DataFrame) -> DataFrame:
    """Rows for a hypergeometric test: u, v (with strands), best, shared, u_barcodes, v_barcodes, all_barcodes.

    Two mirrored rows for each orientation with shared barcodes. all_barcodes is a number, or a relation of one row
    and column with it, so that no action is needed while the plan is built.
    """
    ends = barcodes_per_end(imap, min_reads)
    side = lambda c: ends.select(F.col("contig").alias(c), F.col("is_head").alias(f"{c}_head"), F.col("barcodes").alias(f"{c}_barcodes"))
    rows = unpivot_pairs(pairs).withColumns({"u_head": F.col("orientation") < 2, "v_head": F.col("orientation") % 2 == 0})
    rows = rows.join(side("u"), ["u", "u_head"], "left").join(side("v"), ["v", "v_head"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("u_barcodes", "v_barcodes")})
    rows = rows.withColumn("best", F.when(F.col("shared") == F.col("most"), F.lit("T")).otherwise(F.lit("F")))
    if isinstance(all_barcodes, DataFrame):
        rows = rows.join(F.broadcast(all_barcodes.toDF("all_barcodes").withColumn("all_barcodes", F.col("all_barcodes").cast("long"))))
    else:
        rows = rows.withColumn("all_barcodes", F.lit(all_barcodes).cast("long"))
    u, v, o = F.col("u"), F.col("v"), F.col("orientation")
    flip = lambda c: F.translate(c, "+-", "-+")
    us, vs = sense_sign(o, True), sense_sign(o, False)
    swap = {
        "u": (F.concat(u, us), F.concat(v, flip(vs))), "v": (F.concat(v, vs), F.concat(u, flip(us))),
        "u_barcodes": (F.col("u_barcodes"), F.col("v_barcodes")), "v_barcodes": (F.col("v_barcodes"), F.col("u_barcodes")),
    }
    return mirrored(rows, swap, ["best", "shared", "all_barcodes"]).select("u", "v", "best", "shared", "u_barcodes", "v_barcodes", "all_barcodes")
