"""Result files. Each is a folder of Spark text or csv parts, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import vertices


def _lines(parts: list[DataFrame]) -> DataFrame:
    """One column of text, part after part and each in the order of its column `place`."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(F.lit(i).alias("part"), F.col("place").cast("string").alias("place"), "value")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("part", "place").select("value")


def gv_lines(edges: DataFrame, distance: str | None = None) -> DataFrame:
    """The undirected graph file, line by line."""
    spark = edges.sparkSession
    nodes = vertices(edges)
    idx = lambda c: nodes.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_idx"))
    rows = edges.join(idx("u"), "u").join(idx("v"), "v")
    extra = F.when(F.col(distance).isNotNull(), F.concat(F.lit(", d="), F.col(distance), F.lit(", maxd="), F.coalesce("max_dist", distance))).otherwise("") if distance else F.lit("")
    one = lambda text: spark.createDataFrame([("", text)], "place string, value string")
    wide = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    node_lines = nodes.select(wide("idx").alias("place"), F.concat("idx", F.lit(" [id="), "id", F.lit("];")).alias("value"))
    edge_lines = rows.select(
        F.concat_ws("\t", "u", "v").alias("place"),
        F.concat("u_idx", F.lit("--"), "v_idx", F.lit(" [label="), "orientation", F.lit(", weight="), "weight", extra, F.lit("];")).alias("value"),
    )
    return _lines([one("graph G {"), node_lines, edge_lines, one("}")])


def dist_gv_lines(digraph: DataFrame, lengths: DataFrame) -> DataFrame:
    """The distance graph file, line by line: both strands of all contigs, then the oriented edges."""
    spark = digraph.sparkSession
    one = lambda text: spark.createDataFrame([("", text)], "place string, value string")
    q = F.lit('"')
    ends = lengths.select("contig", "length", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("s"))
    node_lines = ends.select(F.concat("contig", "s").alias("place"), F.concat(q, "contig", "s", q, F.lit(" [l="), "length", F.lit("]")).alias("value"))
    edge_lines = digraph.select(
        F.concat_ws("\t", "src", "src_strand", "dst", "dst_strand").alias("place"),
        F.concat(q, "src", "src_strand", q, F.lit(" -> "), q, "dst", "dst_strand", q, F.lit(" [d="), "d", F.lit(" e="), F.format_string("%.1f", F.col("e").cast("double")), F.lit(" n="), "n", F.lit("]")).alias("value"),
    )
    return _lines([one("digraph distances {"), node_lines, edge_lines, one("}")])


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.write.mode("overwrite").option("compression", compression).text(path)


def write_tsv(frame: DataFrame, path: str, order: list | None = None, header: bool = True) -> None:
    rows = frame.orderBy(*order) if order else frame
    rows.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).option("emptyValue", "").csv(path)


def barcode_counts(mult: DataFrame) -> DataFrame:
    """Most reads first, then by barcode."""
    return mult.orderBy(F.desc("mult"), "barcode")


def main_table(pair_rows: DataFrame) -> DataFrame:
    names = {"u": "U", "v": "V", "best": "Best_orientation", "shared": "Shared_barcodes", "u_barcodes": "U_barcodes", "v_barcodes": "V_barcodes", "all_barcodes": "All_barcodes"}
    return pair_rows.withColumnsRenamed(names)


def barcode_stats_json(counts: DataFrame, low: int, high: int) -> DataFrame:
    """One line of JSON about the barcodes."""
    fields = F.struct(
        F.col("all_unfiltered").alias("All_barcodes_unfiltered"), F.col("all_filtered").alias("All_barcodes_filtered"), F.col("scaffold_end").alias("Scaffold_end_barcodes"),
        F.lit(low).alias("Min_barcode_reads_threshold"), F.lit(high).alias("Max_barcode_reads_threshold"),
    )
    return counts.select(F.to_json(fields).alias("value"))


def fasta_lines(records: DataFrame) -> DataFrame:
    head = F.concat(F.lit(">"), "name", F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), "comment")).otherwise(""))
    return records.select(F.concat(head, F.lit("\n"), "seq").alias("value"))


def pseudo_read_lines(cuts: DataFrame, fasta: bool = False) -> DataFrame:
    """Interleaved read pairs as text."""
    name = F.concat("name", F.lit("_f"), "read_num", F.lit(" BX:Z:"), "barcode")
    mate = lambda s, q: F.concat_ws("\n", F.concat(F.lit(">"), name), F.col(s)) if fasta else F.concat_ws("\n", F.concat(F.lit("@"), name), F.col(s), F.lit("+"), F.col(q))
    return cuts.select(F.concat_ws("\n", mate("fwd", "fwd_qual"), mate("rev", "rev_qual")).alias("value"))


def param_lines(*estimates: DataFrame) -> DataFrame:
    """A line `name<tab>value` for each column of the one-row frames, in their order; none where a value is missing."""
    parts = []
    for frame in estimates:
        for name in frame.columns:
            parts.append(frame.filter(F.col(name).isNotNull()).select(F.lit("").alias("place"), F.concat_ws("\t", F.lit(name), F.col(name).cast("string")).alias("value")))
    return _lines(parts)


def append_params(lines: DataFrame, path: str) -> None:
    """Adds the lines to those that other steps have left there."""
    lines.coalesce(1).write.mode("append").text(path)
