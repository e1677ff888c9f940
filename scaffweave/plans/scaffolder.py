"""A whole scaffolding run. Frames are lazy but for numbered rows, which are checkpointed when they are asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import bx_from_comment
from ..operators import alignments as al
from ..operators import checkpoint as ck
from ..operators import contigs as ct
from ..operators import distance as ds
from ..operators import graph as gr
from ..operators import kmers as km
from ..operators import longreads as lr
from ..operators import pairs as pr
from ..operators import sinks
from ..operators.onefile import write_one_file, write_table
from ..params import ScaffoldParams
from ..sources import sequences as sq


@dataclass
class ScaffoldResult:
    imap: DataFrame
    mult: DataFrame
    lengths: DataFrame
    pairs: DataFrame
    edges: DataFrame
    digraph: DataFrame
    samples: DataFrame | None = None
    stats: DataFrame | None = None
    extra: dict = field(default_factory=dict)


class Scaffolder:
    """Scaffolder(params).run(spark) reads the inputs; from_counts begins with barcodes on contig ends."""

    def __init__(self, params: ScaffoldParams):
        self.params = params.named()

    def run(self, spark: SparkSession) -> ScaffoldResult:
        p = self.params
        inputs = [*p.inputs, *(sq.read_fof(spark, p.fof_name) if p.fof_name else [])]
        if not inputs:
            raise ValueError("there are no inputs")
        kind = sq.detect_format(inputs)
        if (kind == "reads") != p.kmer_mode:
            raise ValueError(f"inputs are {kind}, which the mode does not read")
        if any(x.endswith(".bam") for x in inputs):
            raise ValueError("convert BAM files to text (with headers) first")
        return self._from_reads(spark, inputs) if p.kmer_mode else self._from_alignments(spark, inputs)

    def _from_alignments(self, spark: SparkSession, inputs: list[str]) -> ScaffoldResult:
        p = self.params
        header = sq.read_sam_header(spark, *inputs)
        if p.file:
            lengths = ct.contig_lengths(sq.read_contigs(spark, p.file))
            ct.validate_header(header, lengths)
        else:
            lengths = header.groupBy(F.col("contig_id").alias("contig")).agg(F.min("length").alias("length"))
        rows = al.with_barcodes(sq.read_alignments(spark, *inputs))
        imap = al.alignment_end_counts(al.good_pairs(al.join_mates(al.mate_columns(rows)), p.seq_id), lengths, p.min_size, p.end_length)
        return self.from_counts(imap, al.alignment_multiplicity(rows), lengths)

    def _from_reads(self, spark: SparkSession, inputs: list[str]) -> ScaffoldResult:
        p = self.params
        contigs = sq.read_contigs(spark, p.file)
        reads = sq.read_sequences(spark, *inputs)
        mult = sq.read_multiplicity(spark, p.multfile) if p.multfile else pr.barcode_multiplicity(reads.select(bx_from_comment(F.col("comment")).alias("barcode")))
        ends = ct.contig_ends(contigs, p.min_size, p.end_length)
        imap = km.kmer_end_counts(km.read_pairs(reads), mult, ends, p.k_value, p.j_index)
        return self.from_counts(imap, mult, ct.contig_lengths(contigs.filter(F.col("length") >= p.min_size)))

    def run_long(self, spark: SparkSession, cut: int = 250, min_length: int = 2000, genome_size: int = 0, span_share: float = 0.25, percentile: float = 50) -> ScaffoldResult:
        """A run over long reads by k-mers: contigs are named by their numbers, every read of min_length letters or more is a
        barcode (its place in all files, from 1) and is cut into pairs, which are placed on the ends of contigs.

        `extra` holds `contigs` as renamed, `bx_mult`, and `params`: the span (if genome_size is told) and the percentile
        of read lengths as one-row frames. All of it is lazy, but for the numbers, which need counts of the files.
        """
        p = self.params
        if not p.kmer_mode:
            raise ValueError("long reads are placed by k-mers; for the other mode cut them and align the pairs")
        inputs = [*p.inputs, *(sq.read_fof(spark, p.fof_name) if p.fof_name else [])]
        if not inputs:
            raise ValueError("there are no inputs")
        # numbered where the files are read: neither contigs nor reads are dealt or saved
        contigs = sq.read_contigs(spark, p.file, number="place").withColumn("contig_id", F.col("place").cast("string")).drop("place")
        numbered = sq.read_sequences(spark, *inputs, number="barcode")
        cuts = lr.cut_long_reads(numbered, cut, min_length, fasta=True)
        # barcodes stay numbers until pairs are counted, and the number within a read tells its pairs apart
        pairs = cuts.select(F.lit("").alias("file"), F.col("read_num").alias("pair"), "barcode", F.col("fwd").alias("seq1"), F.col("rev").alias("seq2"))
        of_numbers = lr.pseudo_multiplicity(numbered, cut, min_length).withColumnRenamed("n", "mult")
        ends = ct.contig_ends(contigs, p.min_size, p.end_length)
        text = F.col("barcode").cast("string")
        imap = km.kmer_end_counts(pairs, of_numbers, ends, p.k_value, p.j_index).withColumn("barcode", text)
        mult, reads = of_numbers.withColumn("barcode", text), numbered.withColumn("barcode", text)
        result = self.from_counts(imap, mult, ct.contig_lengths(contigs.filter(F.col("length") >= p.min_size)))
        spans = [lr.span(reads, genome_size, span_share)] if genome_size else []
        result.extra.update(contigs=contigs, bx_mult=mult, params=[*spans, lr.length_percentile(reads, percentile)])
        return result

    def from_counts(self, imap: DataFrame, mult: DataFrame, lengths: DataFrame) -> ScaffoldResult:
        p = self.params
        imap, mult = imap.persist(), mult.persist()  # pairs, distances and tables all read them
        ranged = pr.in_multiplicity_range(imap, mult, p.min_mult, p.max_mult)
        pairs = pr.pair_orientations(pr.head_or_tail(ranged, p.min_reads, p.z))
        edges = gr.build_edges(pairs, p.min_links, p.z)
        samples = stats = None
        column = None
        if p.dist_est:
            samples = ds.distance_samples(ranged, lengths, p.end_length, p.min_reads)
            stats = ds.pair_stats(ranged, lengths, p.end_length, p.min_reads)
            edges = ds.edges_with_distances(edges, stats, ds.jaccard_curve(samples), p.dist_bin_size)
            column = "dist" if p.dist_mode == "median" else "max_dist"
        edges = gr.remove_high_degree(edges, p.max_degree)
        return ScaffoldResult(imap, mult, lengths, pairs, edges, gr.to_digraph(edges, p.gap, column), samples, stats)

    def write(self, result: ScaffoldResult) -> None:
        """All files that the options ask for."""
        p = self.params
        counts = pr.count_barcodes(result.imap, result.mult, p.min_mult, p.max_mult)
        sinks.write_lines(sinks.gv_lines(result.edges, "dist" if p.dist_est else None), f"{p.base_name}_original.gv")
        sinks.write_lines(sinks.dist_gv_lines(result.digraph, result.lengths), p.dist_graph_name)
        sinks.write_tsv(sinks.main_table(pr.pair_table(result.pairs, result.imap, p.min_reads, counts.select("all_filtered"))), p.tsv_name, ["U", "V"])
        if p.output_pair:
            sinks.write_tsv(result.pairs, f"{p.base_name}_pair.tsv", ["u", "v"], header=False)
        if p.barcode_counts:
            name = p.barcode_counts if p.barcode_counts.endswith(".tsv") else f"{p.barcode_counts}.tsv"
            sinks.write_tsv(result.mult, name, [F.desc("mult"), "barcode"], header=False)
        if p.dist_est and p.dist_tsv:
            sinks.write_tsv(ds.distance_table(result.edges, result.stats), p.dist_tsv, ["contig1", "contig2"])
        if p.dist_est and p.samples_tsv:
            sinks.write_tsv(result.samples, p.samples_tsv, ["contig_id"])

    def write_tables(self, result: ScaffoldResult, numbers: DataFrame | None = None) -> None:
        """The tables that other programs read, each as one ordered file: links of pairs, checkpoint rows, barcode
        counts in JSON, and for a run over long reads their multiplicities and parameters, if `extra` holds them
        (`bx_mult`, `params`). numbers has (contig, number); by default contigs are named by their numbers."""
        p = self.params
        counts = pr.count_barcodes(result.imap, result.mult, p.min_mult, p.max_mult)
        main = sinks.main_table(pr.pair_table(result.pairs, result.imap, p.min_reads, counts.select("all_filtered")))
        write_table(main, p.tsv_name, ["U", "V", "Best_orientation"])
        if numbers is None:
            numbers = result.lengths.select("contig", F.col("contig").cast("long").alias("number"))
        rows = ck.checkpoint_rows(result.edges, numbers, "dist" if p.dist_est else None)
        write_table(rows, f"{p.base_name}.tigpair_checkpoint.tsv", ["category", "node_a", "node_b"], header=False)
        write_one_file(sinks.barcode_stats_json(counts, p.min_mult, p.max_mult), f"{p.base_name}_stats.json", ["value"])
        if "bx_mult" in result.extra:
            write_table(result.extra["bx_mult"], f"{p.base_name}_bx_mult.tsv", ["barcode"], header=False)
        if "params" in result.extra:
            write_one_file(sinks.param_lines(*result.extra["params"]), f"{p.base_name}_params.tsv", ["value"])
