"""The scaffold graph as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import max_and_index, second_largest, significant
from .numbering import number_rows
from .pairs import COUNTS


def build_edges(pairs: DataFrame, min_links: int, z: float) -> DataFrame:
    """(u, v, orientation, weight): pairs whose best orientation is significant against the next count.

    The next count is the largest that differs from the best, so orientations that tie for the best don't
    contest each other, and the first of them wins.
    """
    counts = [F.col(c) for c in COUNTS]
    most, place = max_and_index(counts)
    total = most + second_largest(counts)
    kept = pairs.filter((most >= min_links) & significant(most, total, z))
    return kept.select("u", "v", place.alias("orientation"), most.alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def remove_high_degree(edges: DataFrame, max_degree: int) -> DataFrame:
    """Without the edges of contigs that have more than max_degree edges in the whole graph; 0 keeps all."""
    if not max_degree:
        return edges
    high = degrees(edges).filter(F.col("degree") > max_degree).select("id")
    out = edges
    for end in ("u", "v"):
        out = out.join(high.withColumnRenamed("id", end), end, "left_anti")
    return out.select(*edges.columns)


def vertices(edges: DataFrame) -> DataFrame:
    """(idx, id): contigs numbered by their first place in the edges, ordered by (u, v), u before v."""
    numbered = number_rows(edges.select("u", "v"), ["u", "v"], "row")
    ends = numbered.select(F.explode(F.array(F.struct((F.col("row") * 2).alias("place"), F.col("u").alias("id")), F.struct((F.col("row") * 2 + 1).alias("place"), F.col("v").alias("id")))).alias("e"))
    first = ends.select("e.*").groupBy("id").agg(F.min("place").alias("place"))
    return number_rows(first, ["place"], "idx").select("idx", "id")


def to_digraph(edges: DataFrame, gap: int = 100, distance: str | None = None, compat: bool = False) -> DataFrame:
    """(src, src_strand, dst, dst_strand, d, e, n): each edge as an oriented one and its reverse complement.

    d is the fixed gap, or the edge's distance; an edge without one gets the gap (compat: the largest int).
    """
    src = F.when(F.col("orientation") < 2, "-").otherwise("+")
    dst = F.when(F.col("orientation") % 2 == 1, "-").otherwise("+")
    flip = lambda c: F.translate(c, "+-", "-+")
    d = F.lit(gap) if distance is None else F.coalesce(F.col(distance), F.lit(2**31 - 1 if compat else gap))
    one = F.struct(F.col("u").alias("src"), src.alias("src_strand"), F.col("v").alias("dst"), dst.alias("dst_strand"))
    two = F.struct(F.col("v").alias("src"), flip(dst).alias("src_strand"), F.col("u").alias("dst"), flip(src).alias("dst_strand"))
    rows = edges.select(F.explode(F.array(one, two)).alias("r"), d.cast("int").alias("d"), F.lit(float(gap)).alias("e"), F.col("weight").alias("n"))
    return rows.select("r.*", "d", "e", "n")


def better_estimates(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel estimates (d, e, n) as one: that with the least error, then the largest distance; all pairs together."""
    best = F.max(F.struct((-F.col("e")).alias("minus_e"), "d")).alias("b")
    return edges.groupBy(*keys).agg(best, F.sum("n").alias("n")).select(*keys, F.col("b.d").alias("d"), (-F.col("b.minus_e")).alias("e"), "n")


def merged_estimates(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel estimates (d, e, n) as one: the mean weighted by inverse variance, its error, all pairs."""
    w = 1 / (F.col("e") * F.col("e"))
    out = edges.groupBy(*keys).agg(F.sum(w * F.col("d")).alias("wd"), F.sum(w).alias("w"), F.sum("n").alias("n"))
    return out.select(*keys, F.round(F.col("wd") / F.col("w")).cast("int").alias("d"), F.sqrt(1 / F.col("w")).alias("e"), "n")


#: Fixed value: standard deviations that an estimate may be off by.
SIGMAS = 3


def allowed_error(e: Column, extra: float = 0.0) -> Column:
    """How far a distance with the standard deviation e may lie from its estimate; extra is allowed to all."""
    return F.ceil(SIGMAS * e + F.lit(float(extra))).cast("long")


def properties(text: Column) -> Column:
    """(length, coverage) of a contig as a struct, from `l=10 C=5`, `C=5, l=10` or `10 5`; null for other text, and
    coverage null where only l is told."""
    labelled = r"^\s*l\s*=\s*(\d+)(?:[\s,]+C\s*=\s*(\d+))?\s*$"
    turned, bare = r"^\s*C=\s*(\d+)\s*,\s*l\s*=\s*(\d+)\s*$", r"^\s*(\d+)\s+(\d+)\s*$"
    at = lambda form, i: F.regexp_extract(text, form, i).try_cast("long")
    pair = lambda form, length, coverage: F.when(text.rlike(form), F.struct(at(form, length).alias("length"), at(form, coverage).alias("coverage")))
    return F.coalesce(pair(labelled, 1, 2), pair(turned, 2, 1), pair(bare, 1, 2))


def edge_weight(d: Column, target_length: Column) -> Column:
    """What a step along an edge adds to a path: its distance and the length of the contig it leads to; raises below 0."""
    weight = d + target_length
    return F.when(weight >= 0, weight).when(weight < 0, F.raise_error(F.concat(F.lit("an edge of weight "), weight.cast("string"))))


def path_properties(paths: DataFrame, contigs: DataFrame, edges: DataFrame) -> DataFrame:
    """(path_id, n, length, coverage) of paths (path_id, place, contig, strand), places from 0 without gaps.

    A path is as long as its contigs and the distances of the edges (src, src_strand, dst, dst_strand, d) between
    neighbours together; its coverage is that of its contigs (contig, length, coverage). A step without an edge, or to a
    contig that is not known, raises. Steps meet their edges by the four columns and are summed up for each path.
    """
    nodes = paths.join(contigs.select("contig", "length", "coverage"), "contig", "left")
    on = ["path_id", "place"]
    to = nodes.select("path_id", (F.col("place") - 1).alias("place"), F.col("contig").alias("dst"), F.col("strand").alias("dst_strand"), F.col("length").alias("dst_length"))
    steps = nodes.select(*on, F.col("contig").alias("src"), F.col("strand").alias("src_strand")).join(to, on)
    found = steps.join(edges.select("src", "src_strand", "dst", "dst_strand", "d").withColumn("__known", F.lit(True)), ["src", "src_strand", "dst", "dst_strand"], "left")
    name = F.concat("src", "src_strand", F.lit(" -> "), "dst", "dst_strand")
    d = F.when(F.col("__known"), F.col("d")).otherwise(F.raise_error(F.concat(F.lit("no edge "), name)).cast("int"))
    known = lambda c, n: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no contig "), F.col(n))).cast("long"))
    grown = found.select("path_id", edge_weight(d, known("dst_length", "dst")).alias("length"))
    begins = nodes.filter("place = 0").select("path_id", known("length", "contig").alias("length"))
    lengths = begins.unionByName(grown).groupBy("path_id").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    return lengths.join(nodes.groupBy("path_id").agg(F.sum("coverage").alias("coverage")), "path_id").select("path_id", "n", "length", "coverage")
