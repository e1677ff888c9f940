"""Gap lengths from barcode overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import sense_sign
from ..functions.stats import swapped_quantile
from .numbering import number_rows, saved
from .pairs import heads_and_tails, mirrored


def long_ends(imap: DataFrame, lengths: DataFrame, end_length: int, min_reads: int) -> DataFrame:
    """Ends with enough reads on contigs of two end lengths at least; with the contig's length."""
    long = lengths.filter(F.col("length") >= 2 * end_length).select("contig", "length")
    return imap.filter(F.col("n") >= min_reads).join(long, "contig")


def distance_samples(imap: DataFrame, lengths: DataFrame, end_length: int, min_reads: int) -> DataFrame:
    """(contig_id, distance, barcodes_head, barcodes_tail, barcodes_union, barcodes_intersect)."""
    ends = long_ends(imap, lengths, end_length, min_reads)
    length = ends.groupBy("contig").agg(F.max("length").alias("length"))
    h, t = F.col("head") > 0, F.col("tail") > 0
    counts = heads_and_tails(ends).groupBy("contig").agg(
        F.count_if(h).alias("barcodes_head"), F.count_if(t).alias("barcodes_tail"),
        F.count_if(h | t).alias("barcodes_union"), F.count_if(h & t).alias("barcodes_intersect"),
    )
    return counts.join(length, "contig").select(
        F.col("contig").alias("contig_id"), (F.col("length") - 2 * end_length).alias("distance"),
        "barcodes_head", "barcodes_tail", "barcodes_union", "barcodes_intersect",
    )


def jaccard_curve(samples: DataFrame) -> DataFrame:
    """(jaccard, distance) with unique Jaccard scores; of equal ones the lowest contig's."""
    j = F.col("barcodes_intersect") / F.col("barcodes_union")
    return samples.filter("barcodes_union > 0").groupBy(j.alias("jaccard")).agg(F.min_by("distance", "contig_id").alias("distance"))


def pair_stats(imap: DataFrame, lengths: DataFrame, end_length: int, min_reads: int) -> DataFrame:
    """(u, v, orientation, barcodes1, barcodes2, barcodes_union, barcodes_intersect) for pairs u <= v that
    share a barcode, in all four orientations; no union where an end has no barcodes."""
    ends = long_ends(imap, lengths, end_length, min_reads).select("barcode", "contig", "is_head")
    total = ends.groupBy("contig", "is_head").agg(F.count("*").alias("barcodes"))
    a = ends.select("barcode", F.col("contig").alias("u"), F.col("is_head").alias("u_head"))
    b = ends.select("barcode", F.col("contig").alias("v"), F.col("is_head").alias("v_head"))
    orientation = F.when(F.col("u_head"), 0).otherwise(2) + F.when(F.col("v_head"), 0).otherwise(1)
    shared = a.join(b, "barcode").filter("u <= v").groupBy("u", "v", orientation.alias("orientation")).agg(F.count("*").alias("barcodes_intersect"))
    every = shared.select("u", "v").distinct().withColumn("orientation", F.explode(F.array(*map(F.lit, range(4)))))
    rows = every.join(shared, ["u", "v", "orientation"], "left").withColumns({"u_head": F.col("orientation") < 2, "v_head": F.col("orientation") % 2 == 0})
    for c, name in (("u", "barcodes1"), ("v", "barcodes2")):
        rows = rows.join(total.select(F.col("contig").alias(c), F.col("is_head").alias(f"{c}_head"), F.col("barcodes").alias(name)), [c, f"{c}_head"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one, two, both = zero("barcodes1"), zero("barcodes2"), zero("barcodes_intersect")
    return rows.select(
        "u", "v", "orientation", one.alias("barcodes1"), F.when(one > 0, two).otherwise(0).alias("barcodes2"),
        F.when((one > 0) & (two > 0), one + two - both).otherwise(0).alias("barcodes_union"), both.alias("barcodes_intersect"),
    )


#: What names a pair of ends.
PAIR = ["u", "v", "orientation"]
#: Cells that scores from 0 to 1 are dealt into to find their place on the curve.
CELLS = 1000


def _place_on_curve(rows: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the range of the last point whose score is no higher (0 before the first point).

    An as-of lookup: points and rows of one cell of scores are read in order, and a cell begins with the
    last range of the cells before it.
    """
    cell = lambda c: F.floor(F.col(c) * CELLS).cast("long")
    marks = ranked.select(cell("jaccard").alias("cell"), F.col("jaccard").alias("at"), F.lit(0).alias("kind"), "range")
    asked = rows.select(cell("own").alias("cell"), F.col("own").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("range"), F.struct(*keys, "own").alias("row"))
    both = marks.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)).unionByName(asked)
    so_far = Window.partitionBy("cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.max("range").over(so_far)).filter("kind = 1")
    ends = rows.sparkSession.range(CELLS + 1).withColumnRenamed("id", "cell").join(marks.groupBy("cell").agg(F.max("range").alias("last")), "cell", "left")
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # of CELLS rows
    carried = ends.select("cell", F.max("last").over(earlier).alias("carried"))
    found = seen.join(carried, "cell", "left")
    return found.select("row.*", F.coalesce("seen", "carried", F.lit(0)).cast("long").alias("range"))


def _scored(stats: DataFrame) -> DataFrame:
    """stats with their score `own`. Their scores are looked up and joined back, so they are saved: the join of barcodes
    with themselves that they come from runs once."""
    return saved(stats.withColumn("own", F.when(F.col("barcodes_union") > 0, F.col("barcodes_intersect") / F.col("barcodes_union"))))


def _points_by_score(rows: DataFrame, curve: DataFrame, k: int) -> DataFrame:
    """(own, points): the k points of the curve nearest to each different score of rows, the nearest first.

    Of two points equally far the higher score is nearer (the lower one if k is 1). The curve is cut into
    ranges of k points; the k nearest of a score lie in its own range or one of its two neighbours, so a
    score meets 3 k points, never the whole curve. However many rows have a score, it is looked up once.
    """
    ranked = number_rows(curve.select("jaccard", "distance"), ["jaccard"], "rank").withColumn("range", F.floor(F.col("rank") / k).cast("long"))
    placed = _place_on_curve(rows.select("own").filter("own is not null").distinct(), ranked, [])
    near = placed.withColumn("range", F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)))
    met = near.join(ranked.drop("rank"), "range")
    point = F.struct(F.abs(F.col("jaccard") - F.col("own")).alias("far"), (F.col("jaccard") if k == 1 else -F.col("jaccard")).alias("tie"), "jaccard", "distance")
    return met.groupBy("own").agg(F.slice(F.sort_array(F.collect_list(point)), 1, k).alias("points"))


def nearest_points(stats: DataFrame, curve: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """For each row with a union, its own_jaccard and the k points of the curve with the nearest scores."""
    keys = keys or PAIR
    rows = _scored(stats.select(*keys, "barcodes_union", "barcodes_intersect"))
    found = rows.join(_points_by_score(rows, curve, k), "own").select(*keys, F.col("own").alias("own_jaccard"), F.explode("points").alias("point"))
    return found.select(*keys, "own_jaccard", "point.jaccard", "point.distance")


def with_distances(rows: DataFrame, curve: DataFrame, k: int) -> DataFrame:
    """rows (with barcodes_union and barcodes_intersect) and min_dist, dist, max_dist from the distances of the k nearest
    points of the curve, and jaccard; nulls where there is no union. Each different score is estimated once."""
    scored = _scored(rows)
    d = F.array_sort(F.transform("points", lambda x: x["distance"]))
    by_score = _points_by_score(scored, curve, k).select("own", d.alias("d")).select(
        "own", F.floor(swapped_quantile(F.col("d"), 0.01)).cast("int").alias("min_dist"),
        F.floor(swapped_quantile(F.col("d"), 0.5) + 0.5).cast("int").alias("dist"),
        F.ceil(swapped_quantile(F.col("d"), 0.99)).cast("int").alias("max_dist"),
        F.col("own").alias("jaccard"),
    )
    return scored.join(by_score, "own", "left").drop("own")


def estimate_distances(stats: DataFrame, curve: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """(min_dist, dist, max_dist, jaccard) of each pair that has a union, if the curve has any point."""
    found = with_distances(stats.filter("barcodes_union > 0"), curve, k).filter("jaccard is not null")
    return found.select(*(keys or PAIR), "min_dist", "dist", "max_dist", "jaccard")


def edges_with_statistics(edges: DataFrame, stats: DataFrame, curve: DataFrame, k: int) -> DataFrame:
    """Edges with the statistics of their pairs and their distances, nulls where there are none."""
    return with_distances(edges.join(stats, PAIR, "left"), curve, k)


def edges_with_distances(edges: DataFrame, stats: DataFrame, curve: DataFrame, k: int) -> DataFrame:
    return edges_with_statistics(edges, stats, curve, k).select(*edges.columns, "min_dist", "dist", "max_dist", "jaccard")


def distance_table(edges: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Two mirrored rows for each edge that has statistics (its own, or those of stats); NA where nothing is estimated."""
    rows = edges.join(stats, PAIR) if stats is not None else edges.filter("barcodes1 is not null")
    u, v, o = F.col("u"), F.col("v"), F.col("orientation")
    flip = lambda c: F.translate(c, "+-", "-+")
    us, vs = sense_sign(o, True), sense_sign(o, False)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("min_dist", "dist", "max_dist")})
    swap = {
        "contig1": (F.concat(u, us), F.concat(v, flip(vs))), "contig2": (F.concat(v, vs), F.concat(u, flip(us))),
        "barcodes1": (F.col("barcodes1"), F.col("barcodes2")), "barcodes2": (F.col("barcodes2"), F.col("barcodes1")),
    }
    out = mirrored(rows, swap, ["min_dist", "dist", "max_dist", "barcodes_union", "barcodes_intersect"])
    return out.select("contig1", "contig2", "min_dist", "dist", "max_dist", "barcodes1", "barcodes2", "barcodes_union", "barcodes_intersect")
