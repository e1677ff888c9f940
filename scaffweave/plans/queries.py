"""Operators over the given tables, and the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formatting, sequence, stats, tags
from ..operators import alignments as al
from ..operators import checkpoint as ck
from ..operators import contigs as ct
from ..operators import distance as ds
from ..operators import graph as gr
from ..operators import kmers as km
from ..operators import longreads as lr
from ..operators import pairs as pr
from ..operators import sinks
from ..operators.numbering import number_rows, shared_folder
from ..operators.onefile import write_one_file, write_table
from ..sources import dot, graphs, offsets
from ..sources.rich import read_rich
from ..sources.sequences import fasta_index, interleave, read_alignments, read_contigs, read_fastq, read_multiplicity, read_records, read_sam_header, read_sequences
from ..params import ScaffoldParams
from . import standins as st
from .scaffolder import Scaffolder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CTES = {
    "pos": "select cast(l_suppkey as varchar) barcode, p_brand contig, cast(l_quantity as int) position from lineitem join part on l_partkey = p_partkey",
    "imap": "select barcode, contig, position <= 20 is_head, count(*) n from pos where position <= 20 or position > 30 group by all",
    "mult": "select cast(l_suppkey as varchar) barcode, count(*) mult from lineitem group by all",
    "lens": "select distinct p_brand contig, 40 + cast(regexp_extract(p_brand, '(\\d+)', 1) as int) length from part",
    "ranged": "select i.* from imap i join mult m using (barcode) where mult between 550 and 650",
    "ht": "select barcode, contig, coalesce(sum(n) filter (where is_head), 0) head, coalesce(sum(n) filter (where not is_head), 0) tail from imap group by all",
    "ends": "select *, head >= tail is_head from ht where head + tail >= 5 and 2 * greatest(head, tail) - head - tail > 0.5244005127080407 * sqrt(head + tail)",
    "pairs": """select a.contig u, b.contig v, count(*) filter (where a.is_head and b.is_head) hh, count(*) filter (where a.is_head and not b.is_head) ht,
        count(*) filter (where not a.is_head and b.is_head) th, count(*) filter (where not a.is_head and not b.is_head) tt
        from ends a join ends b on a.barcode = b.barcode and a.contig < b.contig group by all""",
    "best": "select *, greatest(hh, ht, th, tt) mx, case when hh = mx then 0 when ht = mx then 1 when th = mx then 2 else 3 end orientation, coalesce(list_max(list_filter([hh, ht, th, tt], lambda z: z <> mx)), 0) sec from pairs",
    "edges": "select u, v, orientation, mx weight from best where 2 * mx - (mx + sec) > 0.5244005127080407 * sqrt(mx + sec)",
    "per_end": "select contig, is_head, count(*) barcodes from imap where n >= 5 group by all",
    "dends": "select barcode, contig, is_head, length from ranged join lens using (contig) where n >= 5 and length >= 40",
    "samples": """select contig contig_id, max(length) - 40 distance, count(*) filter (where h) barcodes_head, count(*) filter (where t) barcodes_tail,
        count(*) barcodes_union, count(*) filter (where h and t) barcodes_intersect
        from (select barcode, contig, length, bool_or(is_head) h, bool_or(not is_head) t from dends group by all) group by contig""",
    "curve": "select barcodes_intersect / barcodes_union jaccard, arg_min(distance, contig_id) distance from samples where barcodes_union > 0 group by 1",
    "total": "select contig, is_head, count(*) b from dends group by all",
    "shared": "select a.contig u, b.contig v, case when a.is_head then 0 else 2 end + case when b.is_head then 0 else 1 end orientation, count(*) both_ from dends a join dends b on a.barcode = b.barcode and a.contig <= b.contig group by all",
    "stats": """select p.u, p.v, o.orientation, coalesce(x.b, 0) barcodes1, case when x.b is null then 0 else coalesce(y.b, 0) end barcodes2,
        case when x.b is null or y.b is null then 0 else x.b + y.b - coalesce(both_, 0) end barcodes_union, coalesce(both_, 0) barcodes_intersect
        from (select distinct u, v from shared) p cross join (select unnest([0, 1, 2, 3]) orientation) o
        left join shared s on s.u = p.u and s.v = p.v and s.orientation = o.orientation
        left join total x on x.contig = p.u and x.is_head = (o.orientation < 2) left join total y on y.contig = p.v and y.is_head = (o.orientation % 2 = 0)""",
    "near": """select u, v, orientation, own own_jaccard, jaccard, distance from (select *, row_number() over (partition by u, v, orientation order by abs(jaccard - own), jaccard desc) k
        from (select *, barcodes_intersect / barcodes_union own from stats where barcodes_union > 0) cross join curve) where k <= 5""",
    "lists": "select u, v, orientation, any_value(own_jaccard) jaccard, list_sort(list(distance)) d, len(d) - 1 last from near group by u, v, orientation",
    "quantiles": """select u, v, orientation, jaccard, """
    + ", ".join(
        f"({q} * last - floor({q} * last)) * d[cast(floor({q} * last) as int) + 1] + (1 - ({q} * last - floor({q} * last))) * d[cast(ceil({q} * last) as int) + 1] {name}"
        for q, name in ((0.01, "q1"), (0.5, "q50"), (0.99, "q99"))
    )
    + " from lists",
    "est": "select u, v, orientation, cast(floor(q1) as int) min_dist, cast(floor(q50 + 0.5) as int) dist, cast(ceil(q99) as int) max_dist, jaccard from quantiles",
    "seqs": "select doc_id, translate(regexp_replace(lower(text), '[^a-z ]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') seq from documents",
    "solid": "select doc_id, replace(seq, ' ', '') seq from seqs",
    "windows": "select doc_id, i, substr(seq, i, 12) w from seqs, (select unnest(range(1, (select max(length(seq)) from seqs) - 10)) i) where i <= length(seq) - 11",
    "canon": "select doc_id, i, case when position(' ' in w) = 0 then least(w, reverse(translate(w, 'ACGT', 'TGCA'))) end kmer from windows",
    "pairs_raw": """select event_id ord, cast(cast(floor((event_id - case when event_id % 7 = 0 then 1 else 0 end) / 2) as bigint) as varchar) qname,
        case when value > 100 then 97 when event_id % 2 = 0 then 99 else 147 end flag, 'c' || (user_id % 3) rname, cast(floor(value) as int) % 400 + 1 pos,
        case when value < 20 then 0 else 60 end mapq, 100 - event_id % 10 - event_id % 4 si, (user_id // 3) || '-1' barcode from events""",
    "mates": """select qname, min_by(flag, ord) f1, max_by(flag, ord) f2, min_by(mapq, ord) m1, max_by(mapq, ord) m2, min_by(si, ord) s1, max_by(si, ord) s2,
        min_by(rname, ord) r1, max_by(rname, ord) r2, max_by(barcode, ord) barcode, min_by(pos, ord) p1, max_by(pos, ord) p2
        from pairs_raw group by qname having count(*) = 2 and max(ord) < (select max(ord) from pairs_raw)""",
    "reads": "select item_id, translate(regexp_replace(lower(text), '[^a-z ]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') seq from benchmark",
    "ids": """select id, row_number() over (order by place) k from (select id, min(place) place from (
        select u id, 2 * (row_number() over (order by u, v)) place from edges union all select v, 2 * (row_number() over (order by u, v)) + 1 from edges) group by id)""",
    "cuts": """select doc_id, read_num, substr(seq, s, size) s1, reverse(translate(substr(seq, case when read_num = whole then length(seq) - size + 1 else s + 60 end, size), 'ACGT', 'TGCA')) s2 from (
        select *, case when read_num = whole then length(seq) - rest else read_num * 120 end + 1 s, case when read_num = whole then least(60, rest) else 60 end size from (
          select doc_id, seq, length(seq) // 120 whole, length(seq) % 120 rest, unnest(range(0, length(seq) // 120 + case when length(seq) % 120 = 0 then 0 else 1 end)) read_num from solid where length(seq) >= 120))""",
    "end_rows": """select 2 * k - h end_idx, contig, h = 1 is_head, case when h = 1 then substr(seq, 1, cut) else substr(seq, length(seq) - cut + 1, cut) end seq from (
        select row_number() over (order by doc_id) k, doc_id contig, seq, case when length(seq) <= 600 then length(seq) // 2 else 300 end cut from solid where length(seq) >= 500) cross join (select unnest([1, 0]) h)""",
    "end_index": """select kmer, min(end_idx) end_idx from (select end_idx, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) kmer from (select end_idx, substr(seq, i, 20) w from end_rows, (select unnest(range(1, 282)) i) where i <= length(seq) - 19))
        group by kmer having min(end_idx) = max(end_idx)""",
    "mate_best": """select doc_id, read_num, mate, end_idx from (select doc_id, read_num, mate, n, end_idx, cnt, row_number() over (partition by doc_id, read_num, mate order by cnt desc, end_idx) k from (
        select doc_id, read_num, mate, n, end_idx, count(*) cnt from (select doc_id, read_num, mate, n, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) kmer from (
          select doc_id, read_num, mate, length(s) - 19 n, substr(s, i, 20) w from (select doc_id, read_num, 1 mate, s1 s from cuts union all select doc_id, read_num, 2, s2 from cuts), (select unnest(range(1, 42)) i) where i <= length(s) - 19)) join end_index using (kmer) group by all)) where k = 1 and cnt / n > 0.55""",
    "reads_canon": "select item_id, case when position(' ' in w) = 0 then least(w, reverse(translate(w, 'ACGT', 'TGCA'))) end kmer from (select item_id, substr(seq, i, 12) w from reads, (select unnest(range(1, 2000)) i) where i <= length(seq) - 11)",
    "brands": "select p_brand contig, row_number() over (order by p_brand) k from (select distinct p_brand from part)",
    "est_rows": "select l_suppkey % 50 src_, l_partkey % 20 dst_, cast(l_quantity as int) d, cast(1 + l_linenumber as double) e, cast(l_quantity as bigint) n from lineitem",
}


def _sql(body: str) -> str:
    """The statement with the tables that it needs, and those that they need, in order."""
    import re

    names = list(_CTES)
    need: list[str] = []

    def add(text: str) -> None:
        for name in names:
            if name not in need and re.search(rf"\b(from|join)\s+\(?\s*{name}\b|, {name}\b(?!\.)", text):
                add(_CTES[name])
                if name not in need:
                    need.append(name)

    add(body)
    return ("with " + ", ".join(f"{n} as ({_CTES[n]})" for n in need) + " " if need else "") + body


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _sql(sql)
        return f

    return keep


def _imap(spark, sf):
    return pr.end_counts(st.hits(spark, sf).withColumn("is_head", tags.is_head_by_position(F.col("position"), F.lit(st.SIZE), st.END)))


def _ends(spark, sf):
    return pr.head_or_tail(_imap(spark, sf), st.MIN_READS, st.Z30)


def _pairs(spark, sf):
    return pr.pair_orientations(_ends(spark, sf))


def _edges(spark, sf):
    return gr.build_edges(_pairs(spark, sf), 0, st.Z30)


def _ranged(spark, sf):
    return pr.in_multiplicity_range(_imap(spark, sf), st.multiplicity(spark, sf), st.LOW, st.HIGH)


def _samples(spark, sf):
    return ds.distance_samples(_ranged(spark, sf), st.lengths(spark, sf), st.END, st.MIN_READS)


def _stats(spark, sf):
    return ds.pair_stats(_ranged(spark, sf), st.lengths(spark, sf), st.END, st.MIN_READS)


def _curve(spark, sf):
    return ds.jaccard_curve(_samples(spark, sf))


def _near(spark, sf):
    return ds.nearest_points(_stats(spark, sf), _curve(spark, sf), 5)


def _placed_edges(spark, sf):
    return ds.edges_with_distances(_edges(spark, sf), _stats(spark, sf), _curve(spark, sf), 5)


def _brand_numbers(spark, sf):
    brands = st.table(spark, sf, "part").select(F.col("p_brand").alias("contig")).distinct()
    return number_rows(brands, ["contig"], "number", start=1)


def _windows(spark, sf, k=12):
    return km.kmer_rows(st.sequences(spark, sf), "seq", k, ["doc_id"])


@_query("select barcode, contig, is_head, n from imap")
def agg_imap(spark, sf):
    return _imap(spark, sf)


@_query("select * from mult")
def agg_barcode_mult(spark, sf):
    return st.multiplicity(spark, sf)


@_query("select barcode, mult, row_number() over (order by mult desc, barcode) rk from mult")
def sort_barcodes(spark, sf):
    rows = st.multiplicity(spark, sf).withColumn("minus", -F.col("mult"))
    return number_rows(rows, ["minus", "barcode"], "rk", start=1).select("barcode", "mult", "rk")


@_query("select barcode, contig, is_head, n from ranged")
def flt_mult_range(spark, sf):
    return _ranged(spark, sf)


@_query("select barcode, contig, sum(head) head, sum(tail) tail from ht group by all")
def join_zero_fill(spark, sf):
    return pr.heads_and_tails(_imap(spark, sf))


@_query("select barcode, contig, head, tail, is_head from ends")
def agg_head_or_tail(spark, sf):
    return _ends(spark, sf).select("barcode", "contig", "head", "tail", "is_head")


@_query("select u, v, hh, ht, th, tt from pairs")
def agg_pair_orient(spark, sf):
    return _pairs(spark, sf)


@_query("select u, v, mx, orientation, sec from best")
def agg_argmax4(spark, sf):
    counts = [F.col(c) for c in pr.COUNTS]
    most, place = stats.max_and_index(counts)
    return _pairs(spark, sf).select("u", "v", most.alias("mx"), place.alias("orientation"), stats.second_largest(counts).alias("sec"))


@_query("select u, v, orientation, weight from edges")
def graph_build(spark, sf):
    return _edges(spark, sf)


@_query("select id, count(*) degree from (select u id from edges union all select v from edges) group by id")
def agg_degree(spark, sf):
    return gr.degrees(_edges(spark, sf))


@_query("""select u, v, orientation, weight from edges where not exists (select 1 from (select id from (select u id from edges union all select v from edges) group by id having count(*) > 10) d where d.id in (u, v))""")
def graph_remove_degree(spark, sf):
    return gr.remove_high_degree(_edges(spark, sf), 10)


@_query("""select src, src_strand, dst, dst_strand, 100 d, 100.0 e, weight n from (
    select u src, case when orientation < 2 then '-' else '+' end src_strand, v dst, case when orientation % 2 = 1 then '-' else '+' end dst_strand, weight from edges union all
    select v, case when orientation % 2 = 1 then '+' else '-' end, u, case when orientation < 2 then '+' else '-' end, weight from edges)""")
def graph_to_digraph(spark, sf):
    return gr.to_digraph(_edges(spark, sf), 100)


@_query("""select row_number() over (order by place) - 1 idx, id from (select id, min(place) place from (
    select u id, 2 * (row_number() over (order by u, v)) place from edges union all select v, 2 * (row_number() over (order by u, v)) + 1 from edges) group by id)""")
def graph_numbering(spark, sf):
    return gr.vertices(_edges(spark, sf))


_PAIR_TSV = """select u || us u, v || vs v, best, shared, ub u_barcodes, vb v_barcodes, all_barcodes from (
    select p.u, p.v, us, vs, best, shared, coalesce(a.barcodes, 0) ub, coalesce(b.barcodes, 0) vb from (select u, v, o.orientation, o.shared, case when o.shared = greatest(hh, ht, th, tt) then 'T' else 'F' end best,
        case when o.orientation < 2 then '-' else '+' end us, case when o.orientation % 2 = 1 then '-' else '+' end vs from pairs, unnest([{'orientation': 0, 'shared': hh}, {'orientation': 1, 'shared': ht}, {'orientation': 2, 'shared': th}, {'orientation': 3, 'shared': tt}]) t(o)) p
    left join per_end a on a.contig = p.u and a.is_head = (p.orientation < 2) left join per_end b on b.contig = p.v and b.is_head = (p.orientation % 2 = 0) where shared > 0
    union all
    select p.v, p.u, translate(vs, '+-', '-+'), translate(us, '+-', '-+'), best, shared, coalesce(b.barcodes, 0), coalesce(a.barcodes, 0) from (select u, v, o.orientation, o.shared, case when o.shared = greatest(hh, ht, th, tt) then 'T' else 'F' end best,
        case when o.orientation < 2 then '-' else '+' end us, case when o.orientation % 2 = 1 then '-' else '+' end vs from pairs, unnest([{'orientation': 0, 'shared': hh}, {'orientation': 1, 'shared': ht}, {'orientation': 2, 'shared': th}, {'orientation': 3, 'shared': tt}]) t(o)) p
    left join per_end a on a.contig = p.u and a.is_head = (p.orientation < 2) left join per_end b on b.contig = p.v and b.is_head = (p.orientation % 2 = 0) where shared > 0)
    cross join (select count(*) all_barcodes from mult where mult between 550 and 650)"""


@_query(_PAIR_TSV)
def pair_tsv(spark, sf):
    imap = _imap(spark, sf)
    total = pr.count_barcodes(imap, st.multiplicity(spark, sf), st.LOW, st.HIGH).select("all_filtered")
    return pr.pair_table(_pairs(spark, sf), imap, st.MIN_READS, total)


@_query(f"""select cast(row_number() over (order by part, u, v, best, line) - 1 as bigint) ord, line from (
    select 0 part, '' u, '' v, '' best, concat_ws(chr(9), 'U', 'V', 'Best_orientation', 'Shared_barcodes', 'U_barcodes', 'V_barcodes', 'All_barcodes') line
    union all select 1, u, v, best, concat_ws(chr(9), u, v, best, shared, u_barcodes, v_barcodes, all_barcodes) from ({_PAIR_TSV}))""")
def sink_main_one_file(spark, sf):
    """The table of links of pairs, written as one ordered file and read back line by line."""
    path = f"{shared_folder(spark)}/main-{uuid.uuid4()}.tsv"
    write_table(sinks.main_table(pair_tsv(spark, sf)), path, ["U", "V", "Best_orientation"])
    return read_records(spark, [path]).select("ord", "line")


@_query("select contig, is_head, barcodes from per_end")
def agg_barcodes_per_end(spark, sf):
    return pr.barcodes_per_end(_imap(spark, sf), st.MIN_READS)


@_query("select (select count(*) from mult) all_unfiltered, (select count(*) from mult where mult between 550 and 650) all_filtered, (select count(distinct barcode) from imap) scaffold_end")
def agg_count_barcodes(spark, sf):
    return pr.count_barcodes(_imap(spark, sf), st.multiplicity(spark, sf), st.LOW, st.HIGH)


@_query("select contig_id, distance, barcodes_head, barcodes_tail, barcodes_union, barcodes_intersect from samples")
def agg_dist_samples(spark, sf):
    return _samples(spark, sf)


@_query("select round(jaccard, 9) jaccard, distance from curve")
def agg_jaccard_curve(spark, sf):
    return ds.jaccard_curve(_samples(spark, sf)).withColumn("jaccard", F.round("jaccard", 9))


@_query("select u, v, orientation, barcodes1, barcodes2, barcodes_union, barcodes_intersect from stats")
def agg_pair_stats(spark, sf):
    return _stats(spark, sf)


@_query("select u, v, orientation, round(own_jaccard, 9) own_jaccard, round(jaccard, 9) jaccard, distance from near")
def join_nearest(spark, sf):
    return _near(spark, sf).withColumns({c: F.round(c, 9) for c in ("own_jaccard", "jaccard")})


@_query("select u, v, orientation, min_dist, dist, max_dist, round(jaccard, 9) jaccard from est")
def agg_estimate_dist(spark, sf):
    return ds.estimate_distances(_stats(spark, sf), _curve(spark, sf), 5).withColumn("jaccard", F.round("jaccard", 9))


@_query("select u, v, e.orientation, weight, min_dist, dist, max_dist, round(jaccard, 9) jaccard from edges e left join est using (u, v, orientation)")
def graph_edge_dist(spark, sf):
    return _placed_edges(spark, sf).select("u", "v", "orientation", "weight", "min_dist", "dist", "max_dist", F.round("jaccard", 9).alias("jaccard"))


@_query("""select contig1, contig2, coalesce(cast(min_dist as varchar), 'NA') min_dist, coalesce(cast(dist as varchar), 'NA') dist, coalesce(cast(max_dist as varchar), 'NA') max_dist, barcodes1, barcodes2, barcodes_union, barcodes_intersect from (
    select u || case when orientation < 2 then '-' else '+' end contig1, v || case when orientation % 2 = 1 then '-' else '+' end contig2, min_dist, dist, max_dist, barcodes1, barcodes2, barcodes_union, barcodes_intersect from edges e join stats s using (u, v, orientation) left join est using (u, v, orientation)
    union all select v || case when orientation % 2 = 1 then '+' else '-' end, u || case when orientation < 2 then '+' else '-' end, min_dist, dist, max_dist, barcodes2, barcodes1, barcodes_union, barcodes_intersect from edges e join stats s using (u, v, orientation) left join est using (u, v, orientation))""")
def sink_dist_tsv(spark, sf):
    return ds.distance_table(ds.edges_with_statistics(_edges(spark, sf), _stats(spark, sf), _curve(spark, sf), 5))


@_query("select doc_id, count(*) n_windows, count(kmer) n_valid, count(distinct kmer) n_distinct from canon group by doc_id")
def canonical_kmer(spark, sf):
    return _windows(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.count("kmer").alias("n_valid"), F.count_distinct("kmer").alias("n_distinct"))


@_query("""select count(*) n_recorded, cast(sum(n - 1) as bigint) n_collisions, count(*) filter (where lo = hi) n_unique, cast(coalesce(sum(n - n_low) filter (where lo <> hi), 0) as bigint) n_removed from (
    select kmer, min(doc_id) lo, max(doc_id) hi, sum(n) n, arg_min(n, doc_id) n_low from (select kmer, doc_id, count(*) n from canon where kmer is not null group by all) group by kmer)""")
def agg_kmer_index(spark, sf):
    return km.kmer_counters(km.kmer_index(_windows(spark, sf).withColumnRenamed("doc_id", "end_idx").withColumn("end_idx", F.col("end_idx") + 1)))


def _fasta_lines(spark, sf):
    """The documents as lines of FASTA, a header and a sequence each."""
    rows = st.solid_sequences(spark, sf)
    two = F.array(F.struct((2 * F.col("doc_id")).alias("ord"), F.concat(F.lit(">"), F.col("name"), F.lit(" c")).alias("line")), F.struct((2 * F.col("doc_id") + 1).alias("ord"), F.col("seq").alias("line")))
    return rows.select("file", F.explode(two).alias("l")).select("file", "l.ord", "l.line").withColumn("ord", F.col("ord").cast("long"))


_FAI = "select doc_id, length(seq) size, sum(length(seq) + 5 + length(cast(doc_id as varchar))) over (order by doc_id) - length(seq) - 1 off from solid"


@_query(f"select row_number() over (order by doc_id) - 1 ord, concat_ws(chr(9), doc_id, size, cast(off as bigint), size, size + 1) as value from ({_FAI})")
def fasta_index_text(spark, sf):
    return offsets.fai_lines(offsets.offset_index(_fasta_lines(spark, sf))).select("ord", "value")


@_query(f"""select event_id, case when o - off < size then cast(doc_id as varchar) end contig_id, case when o - off < size then cast(o - off as bigint) end as position
    from (select event_id, event_id * 7919 % 3000017 o from events) e asof left join ({_FAI}) i on e.o >= i.off""")
def fasta_locate(spark, sf):
    """Offsets that events give, as sequences and places in them."""
    asked = st.table(spark, sf, "events").select("event_id", F.lit("documents").alias("file"), (F.col("event_id") * 7919 % 3000017).alias("offset"))
    return offsets.locate(offsets.offset_index(_fasta_lines(spark, sf)), asked).select("event_id", "contig_id", "position")


@_query("""select item_id, n_windows, coalesce(n_hits, 0) n_hits, coalesce(n_streaks, 0) n_streaks, coalesce(longest, 0) longest, coalesce(score, 0.0) score, coalesce(score, 0.0) / n_windows share
    from (select item_id, cast(sum(n) as bigint) n_windows from (select item_id, greatest(length(seq) - 11, 0) n from reads) group by all having n_windows > 0)
    left join (select item_id, cast(sum(n) as bigint) n_hits, count(*) n_streaks, max(n) + 11 longest, cast(sum(n - 0.5) as double) score from (select item_id, count(*) n from (
      select item_id, i, i - row_number() over (partition by item_id order by i) g from (select r.item_id, r.i from
        (select item_id, i, case when position(' ' in w) = 0 then least(w, reverse(translate(w, 'ACGT', 'TGCA'))) end kmer from (select item_id, i, substr(seq, i, 12) w from (select item_id, seq, unnest(range(1, length(seq) - 10)) i from reads))) r
        join (select distinct kmer from canon where kmer is not null) x using (kmer))) group by item_id, g) group by item_id) using (item_id)""")
def streak_score(spark, sf):
    """How runs of the documents' 12-mers cover the benchmark's sequences."""
    index = km.kmer_index(_windows(spark, sf).withColumn("end_idx", F.col("doc_id") + 1))
    reads = st.table(spark, sf, "benchmark").select("item_id", st.bases(F.col("text")).alias("seq"))
    return km.streak_scores(km.kmer_rows(reads, "seq", 12, ["item_id"], place=True), index, ["item_id"], 12)


@_query("""select count(*) n_recorded, cast(sum(n - 1) as bigint) n_collisions, count(*) filter (where lo = hi) n_unique, cast(coalesce(sum(n - n_low) filter (where lo <> hi), 0) as bigint) n_removed from (
    select kmer, min(item_id) lo, max(item_id) hi, sum(n) n, arg_min(n, item_id) n_low from (select kmer, item_id, count(*) n from
      (select item_id, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) kmer from (select item_id, substr(seq, i, 40) w from
        (select item_id, translate(seq, ' ', '') seq, unnest(range(1, length(translate(seq, ' ', '')) - 38)) i from reads))) group by all) group by kmer)""")
def kmer_index_of_40(spark, sf):
    """Counters of an index of 40-mers, which two longs hold."""
    reads = st.table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("end_idx"), F.translate(st.bases(F.col("text")), " ", "").alias("seq"))
    return km.kmer_counters(km.kmer_index(km.kmer_rows(reads, "seq", 40, ["end_idx"])))


@_query("""select item_id, end_idx, cnt from (
    select item_id, end_idx, cnt, total, row_number() over (partition by item_id order by cnt desc, end_idx) k from (
      select r.item_id, x.doc_id + 1 end_idx, count(*) cnt from reads_canon r join (select kmer, min(doc_id) doc_id from canon where kmer is not null group by kmer having min(doc_id) = max(doc_id)) x using (kmer) group by all)
    join (select item_id, count(*) total from reads_canon group by all) using (item_id)) where k = 1 and cnt / total > 0.001""")
def agg_best_contig(spark, sf):
    index = km.kmer_index(_windows(spark, sf).withColumn("end_idx", F.col("doc_id") + 1))
    reads = st.table(spark, sf, "benchmark").select("item_id", st.bases(F.col("text")).alias("seq"))
    return km.best_contig(km.kmer_rows(reads, "seq", 12, ["item_id"]), index, 0.001, ["item_id"])



@_query("select doc_id, regexp_full_match(replace(seq, ' ', 'N'), '[ACGTN]*') and length(seq) - length(replace(seq, ' ', '')) <= 0.02 * length(seq) ok from seqs")
def is_valid_read_seq(spark, sf):
    return st.sequences(spark, sf).select("doc_id", sequence.is_valid_read(F.translate("seq", " ", "N")).alias("ok"))


@_query("select doc_id, regexp_full_match(seq, '[ACGTNMRWSYKVHDB]*') ok from seqs")
def is_valid_contig_seq(spark, sf):
    return st.sequences(spark, sf).select("doc_id", sequence.is_valid_contig(F.col("seq")).alias("ok"))


@_query("select count(*) n_contigs, 2 * count(*) + 1 n_slots from solid where length(seq) >= 500")
def count_valid_contigs(spark, sf):
    return ct.count_valid_contigs(st.solid_sequences(spark, sf), 500)


@_query("""select 2 * k - h end_idx, contig, h = 1 is_head, case when h = 1 then substr(seq, 1, cut) else substr(seq, length(seq) - cut + 1, cut) end end_seq from (
    select row_number() over (order by doc_id) k, cast(doc_id as varchar) contig, seq, case when length(seq) <= 600 then length(seq) // 2 else 300 end cut from solid where length(seq) >= 500) cross join (select unnest([1, 0]) h)""")
def scan_contig_ends(spark, sf):
    return ct.contig_ends(st.solid_sequences(spark, sf).withColumnRenamed("name", "contig_id"), 500, 300)


@_query("select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from solid")
def reverse_complement(spark, sf):
    return st.solid_sequences(spark, sf).select("doc_id", sequence.reverse_complement(F.col("seq")).alias("rc"))


@_query("select ord event_id, si identity from pairs_raw")
def seq_identity(spark, sf):
    return al.with_barcodes(st.alignments(spark, sf)).select(F.col("ord").alias("event_id"), "identity")


@_query("select qname, (p1 + p2) // 2 mid_pos from mates")
def join_mate(spark, sf):
    mates = al.join_mates(al.mate_columns(al.with_barcodes(st.alignments(spark, sf))))
    return mates.select("qname", tags.pair_mid_pos(F.col("first.pos"), F.col("second.pos")).alias("mid_pos"))


@_query("""select file, qname, event_id first_id, after1 second_id from (
    select *, lag(qname) over w before, lead(qname, 1) over w next1, lead(qname, 2) over w next2, lead(event_id) over w after1 from (
      select case when event_id % 5000 < 3000 then 'a' else 'b' end file, event_id, cast((event_id + case when event_id % 11 < 4 then event_id % 2 else 0 end) // 2 % 97 as varchar) qname from events)
    window w as (partition by file order by event_id))
    where qname = next1 and qname is distinct from before and qname <> next2""")
def join_mate_runs(spark, sf):
    """Pairs of neighbouring records where names recur, in runs of one to four records."""
    mates = al.join_mates(st.recurring_alignments(spark, sf))
    return mates.select("file", "qname", F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"))


@_query("select barcode, r2 contig, (p1 + p2) // 2 mid_pos from mates where f1 in (99, 147) and f2 in (99, 147) and m1 <> 0 and m2 <> 0 and s1 >= 90 and s2 >= 90 and r1 = r2")
def flt_pair_quality(spark, sf):
    return al.good_pairs(al.join_mates(al.mate_columns(al.with_barcodes(st.alignments(spark, sf)))), 90)


@_query("select barcode, count(*) mult from pairs_raw group by all")
def agg_barcode_mult_sam(spark, sf):
    return al.alignment_multiplicity(al.with_barcodes(st.alignments(spark, sf)))


@_query("select event_id, (user_id // 3) || '-1' parsed from events")
def bx_from_tags(spark, sf):
    return st.alignments(spark, sf).select(F.col("ord").alias("event_id"), tags.bx_from_tags(F.col("tags")).alias("parsed"))


@_query("select event_id, case when event_id % 2 = 0 then 'ACGT' else '' end parsed from events")
def barcode_from_name(spark, sf):
    e = st.table(spark, sf, "events")
    name = F.concat(F.lit("r_"), "user_id", F.when(F.col("event_id") % 2 == 0, "_ACGT").otherwise("_AC-T"))
    return e.select("event_id", tags.barcode_from_name(name).alias("parsed"))


@_query("select conv_id, turn, role || '/' || turn || case when turn % 2 = 0 then '' else '/x' end parsed from conversations")
def strip_read_num(spark, sf):
    c = st.table(spark, sf, "conversations")
    name = F.concat("role", F.lit("/"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/"), F.col("turn").cast("string"))).otherwise("/x"))
    return c.select("conv_id", "turn", tags.strip_read_num(name).alias("parsed"))


@_query("""select doc_id, read_num, substr(seq, s, size) fwd, reverse(translate(substr(seq, case when read_num = whole then length(seq) - size + 1 else s + 250 end, size), 'ACGT', 'TGCA')) rev from (
    select *, case when read_num = whole then length(seq) - rest else read_num * 500 end + 1 s, case when read_num = whole then least(250, rest) else 250 end size from (
      select doc_id, seq, length(seq) // 500 whole, length(seq) % 500 rest, unnest(range(0, length(seq) // 500 + case when length(seq) % 500 = 0 then 0 else 1 end)) read_num from solid where length(seq) >= 500))""")
def lr_cut(spark, sf):
    return lr.cut_long_reads(st.solid_sequences(spark, sf).withColumn("barcode", F.col("doc_id")), 250, fasta=True).select(F.col("barcode").alias("doc_id"), F.col("read_num").cast("long").alias("read_num"), "fwd", "rev")


@_query("select doc_id barcode, case when length(seq) % 500 <> 0 then (length(seq) // 500 + 1) * 2 else length(seq) // 250 end n from solid where length(seq) >= 500")
def lr_bx_mult(spark, sf):
    return lr.pseudo_multiplicity(st.solid_sequences(spark, sf).withColumn("barcode", F.col("doc_id")), 250)


@_query("select row_number() over (order by doc_id) barcode, doc_id from documents")
def lr_barcode(spark, sf):
    return lr.long_read_barcodes(st.table(spark, sf, "documents").select("doc_id"), ["doc_id"]).select("barcode", "doc_id")


@_query("select cast(floor((sum(length(seq)) // 1000) * 0.25) as bigint) span from solid")
def lr_span(spark, sf):
    return lr.span(st.solid_sequences(spark, sf), 1000, 0.25)


@_query("""select (a[greatest(case when n * 0.9 = floor(n * 0.9) then cast(floor(n * 0.9) as int) else cast(floor(n * 0.9) as int) + 1 end, 1)] + a[cast(floor(n * 0.9) as int) + 1]) // 2 read_p90
    from (select list_sort(list(length(seq))) a, count(*) n from solid where length(seq) > 1000)""")
def lr_dist(spark, sf):
    return lr.length_percentile(st.solid_sequences(spark, sf), 90)


@_query("""select category, t.a node_a, t.b node_b, links, gap from (
    select case when dist is null then 10 when dist < 0 then -1 when dist < 500 then 500 when dist < 1000 then 1000 when dist < 5000 then 5000 else 10000 end category,
      unnest([{'a': case when orientation < 2 then 'r' else 'f' end || x.k, 'b': case when orientation % 2 = 0 then 'f' else 'r' end || y.k}, {'a': case when orientation % 2 = 0 then 'r' else 'f' end || y.k, 'b': case when orientation < 2 then 'f' else 'r' end || x.k}]) t,
      weight links, cast(weight * coalesce(dist, 100) as bigint) gap
    from edges e left join est using (u, v, orientation) join brands x on x.contig = e.u join brands y on y.contig = e.v)""")
def ck_rows(spark, sf):
    return ck.checkpoint_rows(_placed_edges(spark, sf), _brand_numbers(spark, sf), "dist")



@_query("select k number, contig from brands")
def rename_contigs(spark, sf):
    return _brand_numbers(spark, sf).select("number", "contig")


@_query("select cast(doc_id as varchar) contig_id, length(seq) length, cast(coalesce(sum(length(seq)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) \"begin\" from solid")
def fasta_index_offsets(spark, sf):
    rows = st.solid_sequences(spark, sf).select("file", "ord", F.col("name").alias("contig_id"), F.length("seq").alias("length"))
    return fasta_index(rows).select("contig_id", "length", "begin")


@_query("select p_partkey, p_brand from part where p_brand in (select p_brand from part where p_size = 1)")
def bloom_filter(spark, sf):
    """Brands that are listed. Spark puts a Bloom filter of its own before a join where that pays."""
    part = st.table(spark, sf, "part")
    return part.join(part.filter("p_size = 1").select("p_brand").distinct(), "p_brand", "left_semi").select("p_partkey", "p_brand")


@_query("select src_, dst_, round(sum(d / (e * e)) / sum(1 / (e * e))) d, round(sqrt(1 / sum(1 / (e * e))), 9) e, cast(sum(n) as bigint) n from est_rows group by all")
def edge_merge(spark, sf):
    return _estimates(spark, sf, gr.merged_estimates).withColumns({"e": F.round("e", 9), "d": F.col("d").cast("double")})


@_query("select src_, dst_, d, e, total n from (select *, row_number() over (partition by src_, dst_ order by e, d desc) k, cast(sum(n) over (partition by src_, dst_) as bigint) total from est_rows) where k = 1")
def edge_better(spark, sf):
    return _estimates(spark, sf, gr.better_estimates)



def _estimates(spark, sf, how):
    lines = st.table(spark, sf, "lineitem")
    rows = lines.select((F.col("l_suppkey") % 50).alias("src_"), (F.col("l_partkey") % 20).alias("dst_"), F.col("l_quantity").cast("int").alias("d"), (1 + F.col("l_linenumber")).cast("double").alias("e"), F.col("l_quantity").cast("long").alias("n"))
    return how(rows, ["src_", "dst_"])


@_query("select barcode, contig, mid_pos <= 150 is_head, count(*) n from (select barcode, r2 contig, (p1 + p2) // 2 mid_pos from mates where f1 in (99, 147) and f2 in (99, 147) and m1 <> 0 and m2 <> 0 and s1 >= 90 and s2 >= 90 and r1 = r2) where mid_pos <= 150 or mid_pos > 250 group by all")
def agg_imap_sam(spark, sf):
    pairs = al.good_pairs(al.join_mates(al.mate_columns(al.with_barcodes(st.alignments(spark, sf)))), 90)
    lengths = spark.createDataFrame([(f"c{i}", 400) for i in range(3)], "contig string, length int")
    return al.alignment_end_counts(pairs, lengths, 100, 150)


@_query("select item_id, length(seq) n_bases, array_to_string(list_transform(range(1, length(seq)), lambda i: case when substr(seq, i, 1) = ' ' or substr(seq, i + 1, 1) = ' ' then '.' else cast(xor(position(substr(seq, i, 1) in 'ACGT') - 1, position(substr(seq, i + 1, 1) in 'ACGT') - 1) as varchar) end), '') colours from reads")
def colour_space(spark, sf):
    reads = st.table(spark, sf, "benchmark").select("item_id", st.bases(F.col("text")).alias("seq"))
    return reads.select("item_id", F.length("seq").alias("n_bases"), sequence.nucleotides_to_colours(F.col("seq")).alias("colours"))


@_query("select o_orderkey, case when o_totalprice >= 1e6 then 'M' when o_totalprice >= 1e3 then 'k' else '' end unit from orders")
def to_si(spark, sf):
    o = st.table(spark, sf, "orders")
    return o.select("o_orderkey", F.regexp_extract(formatting.to_si(F.col("o_totalprice")), "([kMGT]?)$", 1).alias("unit"))


@_query("""select o_orderkey, case when o_totalprice < 1e3 then format('{:.3g} ', o_totalprice) when o_totalprice < 1e6 then format('{:.3g} k', o_totalprice / 1e3) else format('{:.3g} M', o_totalprice / 1e6) end si,
    case when x < 10000000 then cast(x as varchar) when x < 1e9 then format('{:.4g}e6', x / 1e6) when x < 1e12 then format('{:.4g}e9', x / 1e9) else format('{:.4g}e12', x / 1e12) end eng
    from (select *, cast(floor(o_totalprice) as bigint) * o_orderkey x from orders)""")
def short_numbers(spark, sf):
    o = st.table(spark, sf, "orders")
    return o.select("o_orderkey", formatting.to_si(F.col("o_totalprice")).alias("si"), formatting.to_eng(F.floor("o_totalprice") * F.col("o_orderkey")).alias("eng"))


#: The 15 letters in both cases with their sets of bases, each written out, for the statement in SQL.
_SETS = [("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("M", "AC"), ("R", "AG"), ("W", "AT"), ("S", "CG"), ("Y", "CT"), ("K", "GT"), ("V", "ACG"), ("H", "ACT"), ("D", "AGT"), ("B", "CGT"), ("N", "ACGT")]


@_query(f"""with sets as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in _SETS)}) t(k, v)),
    used as (select e.user_id, s.k, case when e.event_id % 2 = 0 then s.k else lower(s.k) end x from events e join sets s on s.k = substr('ACGTMRWSYKVHDBN', cast(e.event_id % 15 as int) + 1, 1)),
    two as (select x a, case when user_id % 3 = 0 then lower(o.k) else o.k end b, p.v va, o.v vb from used join sets p on p.k = used.k join sets o on o.k = substr('NBDHVKYSWRMTGCA', cast(user_id % 15 as int) + 1, 1)),
    joined as (select *, array_to_string(list_filter(['A', 'C', 'G', 'T'], lambda z: contains(va, z) and contains(vb, z)), '') i, array_to_string(list_filter(['A', 'C', 'G', 'T'], lambda z: contains(va, z) or contains(vb, z)), '') u from two),
    named as (select a, b, coalesce(x.k, 'N') i, y.k u from joined left join sets x on x.v = i left join sets y on y.v = u),
    cased as (select a, b, case when a = lower(a) and b = lower(b) then lower(i) else i end both_, case when a = lower(a) or b = lower(b) then lower(u) else u end either from named)
    select a, b, both_, either, both_ in (a, b) part, count(*) n from cased group by all""")
def ambiguity_pairs(spark, sf):
    """Pairs of IUPAC letters in both cases that events give, with the letters of their common and joint bases."""
    letter = lambda order, at: F.substring(F.lit(order), (at % 15).cast("int") + 1, F.lit(1))
    a, b = letter("ACGTMRWSYKVHDBN", F.col("event_id")), letter("NBDHVKYSWRMTGCA", F.col("user_id"))
    rows = st.table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, a).otherwise(F.lower(a)).alias("a"), F.when(F.col("user_id") % 3 == 0, F.lower(b)).otherwise(b).alias("b"))
    x, y = F.col("a"), F.col("b")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", sequence.ambiguity_and(x, y).alias("both_"), sequence.ambiguity_or(x, y).alias("either"), sequence.ambiguity_is_subset(x, y).alias("part"), "n")


@_query("""select item_id, colours, substr(seq, 1, known) || case when known > 0 then repeat('N', length(seq) - known) else seq[1] || repeat('N', length(seq) - 1) end letters from (
    select item_id, seq, position('N' in seq || 'N') - 1 known, array_to_string(list_transform(range(1, length(seq)), lambda i: case when substr(seq, i, 1) = 'N' or substr(seq, i + 1, 1) = 'N' then 'N'
      else cast(xor(position(substr(seq, i, 1) in 'ACGT') - 1, position(substr(seq, i + 1, 1) in 'ACGT') - 1) as varchar) end), '') colours from (select item_id, replace(seq, ' ', 'N') seq from reads))""")
def colour_letters(spark, sf):
    """Sequences with N as colours, and the colours as letters again: right up to the first N, unknown from there on."""
    reads = st.table(spark, sf, "benchmark").select("item_id", F.translate(st.bases(F.col("text")), " ", "N").alias("seq"))
    found = reads.withColumn("colours", sequence.nucleotides_to_colours(F.col("seq")))
    return found.select("item_id", "colours", sequence.colours_to_nucleotides(F.substring("seq", 1, 1), F.col("colours")).alias("letters"))


def _written(spark, rows, suffix: str) -> str:
    """The one column of rows as text files in the shared folder; their path."""
    path = f"{shared_folder(spark)}/written-{uuid.uuid4()}"
    rows.write.text(path)
    return f"{path}/*{suffix}"


@_query("""select cast(doc_id as varchar) "name", 'BX:Z:' || doc_id % 7 || ' x' "comment", length(seq) n_bases, md5(seq) seq_md5, md5(translate(seq, 'ACGT', '@>+I')) qual_md5 from solid""")
def scan_fastq_lines(spark, sf):
    """Reads of several lines, whose qualities begin lines with @, > and +, written to files and read from their splits."""
    rows = st.solid_sequences(spark, sf)
    lines = lambda text, width: F.regexp_replace(text, "(.{%d})" % width, "$1\n")
    head = F.concat(F.lit("@"), F.col("name"), F.lit(" BX:Z:"), F.col("doc_id") % 7, F.lit(" x"))
    text = F.concat_ws("\n", head, lines("seq", 61), F.lit("+"), lines(F.translate("seq", "ACGT", "@>+I"), 47))
    found = read_fastq(spark, _written(spark, rows.select(text), ".txt"))
    return found.select("name", "comment", F.length("seq").alias("n_bases"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


@_query("select ord event_id, flag from pairs_raw where flag in (99, 147)")
def flt_flag(spark, sf):
    return st.alignments(spark, sf).filter(tags.proper_flag(F.col("flag"))).select(F.col("ord").alias("event_id"), "flag")


@_query("select event_id from events where value >= 100 and value <= 450")
def flt_primary(spark, sf):
    flag = (F.lit(99) + F.when(F.col("value") < 100, 256).otherwise(0) + F.when(F.col("value") > 450, 2048).otherwise(0)).cast("int")
    return st.table(spark, sf, "events").filter(tags.primary_flag(flag)).select("event_id")


@_query("select doc_id, length(seq) length from solid where length(seq) >= 500")
def flt_min_size(spark, sf):
    return st.solid_sequences(spark, sf).select("doc_id", F.length("seq").alias("length")).filter("length >= 500")


@_query("select barcode, contig, position from pos where barcode in (select barcode from mult where mult >= 600)")
def flt_known_barcode(spark, sf):
    known = st.multiplicity(spark, sf).filter("mult >= 600")
    return st.hits(spark, sf).join(known, "barcode", "left_semi").select("barcode", "contig", "position")


@_query("select barcode, contig, head, tail from ht where head + tail >= 24")
def flt_min_reads_pair(spark, sf):
    return pr.heads_and_tails(_imap(spark, sf)).filter("head + tail >= 24")


@_query("select u, v, orientation, mx weight from best where mx >= 12 and 2 * mx - (mx + sec) > 0.5244005127080407 * sqrt(mx + sec)")
def flt_min_links(spark, sf):
    return gr.build_edges(_pairs(spark, sf), 12, st.Z30)


@_query("select doc_id, length(seq) length from solid where length(seq) >= 500 and length(seq) >= 800")
def flt_long_read(spark, sf):
    return lr.long_enough(st.solid_sequences(spark, sf), 250, 800).select("doc_id", F.length("seq").alias("length"))


@_query("select contig, length, case when length <= 60 then length // 2 else 30 end cut from lens")
def end_cutoff(spark, sf):
    return st.lengths(spark, sf).select("contig", "length", tags.end_cutoff(F.col("length"), 30).alias("cut"))


@_query("select contig, case when position <= 20 then true when position > 30 then false end is_head, count(*) n from pos group by all")
def head_tail_by_pos(spark, sf):
    rows = st.hits(spark, sf).withColumn("is_head", tags.is_head_by_position(F.col("position"), F.lit(st.SIZE), st.END))
    return rows.groupBy("contig", "is_head").agg(F.count("*").alias("n"))


@_query("select u, v, case when orientation < 2 then '-' else '+' end us, case when orientation % 2 = 1 then '-' else '+' end vs from edges")
def sense_sign(spark, sf):
    o = F.col("orientation")
    return _edges(spark, sf).select("u", "v", sequence.sense_sign(o, True).alias("us"), sequence.sense_sign(o, False).alias("vs"))


@_query("""select contig, round((0.3 * last - floor(0.3 * last)) * d[cast(floor(0.3 * last) as int) + 1] + (1 - (0.3 * last - floor(0.3 * last))) * d[cast(ceil(0.3 * last) as int) + 1], 6) q
    from (select contig, list_sort(list(head)) d, len(d) - 1 last from ht group by contig)""")
def agg_quantile(spark, sf):
    return stats.grouped_quantile(pr.heads_and_tails(_imap(spark, sf)), ["contig"], "head", 0.3).withColumn("q", F.round("q", 6))


@_query("select u, v, 2 * mx - (mx + sec) > 1.6448536269514722 * sqrt(mx + sec) ok from best")
def agg_link_significance(spark, sf):
    counts = [F.col(c) for c in pr.COUNTS]
    most, _ = stats.max_and_index(counts)
    return _pairs(spark, sf).select("u", "v", stats.significant(most, most + stats.second_largest(counts), st.Z05).alias("ok"))


def _event_reads(spark, sf):
    e, i = st.table(spark, sf, "events"), F.col("event_id")
    name = F.concat(F.lit("r"), F.floor(i / 2).cast("string"), F.lit("/"), (i % 2 + 1).cast("string"))
    comment = F.concat(F.lit("BX:Z:"), (F.col("user_id") % 3).cast("string"), F.lit("-1 x"))
    return e.select(F.lit("f").alias("file"), i.alias("ord"), name.alias("name"), comment.alias("comment"), F.translate((i * 7919).cast("string"), "0123456789", "ACGTACGTNC").alias("seq"))


@_query("""select cast(sum(n) as bigint) n_reads, count(*) filter (where n = 2) n_pairs, count(*) filter (where n <> 2) n_single, 0 n_other_name, count(*) filter (where n = 2 and x <> y) n_other_barcode,
    count(*) filter (where n = 2 and x = y and x = 2) n_unknown_barcode, count(*) filter (where n = 2 and x = y and x <> 2) n_usable
    from (select event_id // 2 pair, count(*) n, arg_min(user_id % 3, event_id) x, arg_max(user_id % 3, event_id) y from events group by all)""")
def log_stats(spark, sf):
    reads = _event_reads(spark, sf)
    known = reads.select(tags.bx_from_comment(F.col("comment")).alias("barcode")).distinct().filter("barcode <> '2-1'")
    return km.read_counters(reads, known)


@_query("""select a.event_id // 2 pair, a.user_id % 3 || '-1' barcode, translate(cast(a.event_id * 7919 as varchar), '0123456789', 'ACGTACGTNC') seq1, translate(cast(b.event_id * 7919 as varchar), '0123456789', 'ACGTACGTNC') seq2 from events a join events b on b.event_id = a.event_id + 1 and a.event_id % 2 = 0 where a.user_id % 3 = b.user_id % 3""")
def scan_fastq_pairs(spark, sf):
    return km.read_pairs(_event_reads(spark, sf)).select("pair", "barcode", "seq1", "seq2")


@_query("""select cast(a.doc_id % 7 as varchar) barcode, cast(contig as varchar) contig, is_head, count(*) n from mate_best a join mate_best b on a.doc_id = b.doc_id and a.read_num = b.read_num and a.mate = 1 and b.mate = 2 and a.end_idx = b.end_idx
    join end_rows e on e.end_idx = a.end_idx group by all""")
def agg_read_pair_assign(spark, sf):
    """Pairs cut from all sequences, assigned to the ends of all of them by 20-mers."""
    seqs = st.solid_sequences(spark, sf)
    ends = ct.contig_ends(seqs.withColumnRenamed("name", "contig_id"), 500, 300)
    barcode = (F.col("doc_id") % 7).cast("string")
    cuts = lr.cut_long_reads(seqs.withColumn("barcode", F.col("doc_id")), 60, fasta=True)
    pairs = cuts.select(F.lit("f").alias("file"), F.struct("barcode", "read_num").alias("pair"), (F.col("barcode") % 7).cast("string").alias("barcode"), F.col("fwd").alias("seq1"), F.col("rev").alias("seq2"))
    mult = seqs.groupBy(barcode.alias("barcode")).agg(F.count("*").alias("mult"))
    return km.kmer_end_counts(pairs, mult, ends, 20, 0.55)


@_query("""select l_returnflag letter, case l_returnflag when 'A' then 1 when 'N' then 15 else 5 end mask, case l_returnflag when 'A' then 'A' when 'N' then 'M' else 'A' end with_m,
    case l_returnflag when 'A' then 'M' when 'N' then 'N' else 'V' end or_m, with_m in (l_returnflag, 'M') is_part_of_m, count(*) n from lineitem group by all""")
def ambiguity_codes(spark, sf):
    c, m = F.col("l_returnflag"), F.lit("M")
    rows = st.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return rows.select(
        c.alias("letter"), sequence.ambiguity_mask(c).alias("mask"), sequence.ambiguity_and(c, m).alias("with_m"),
        sequence.ambiguity_or(c, m).alias("or_m"), sequence.ambiguity_is_subset(c, m).alias("is_part_of_m"), "n",
    )


@_query("select row_number() over (order by u, v) - 1 place, u, v from pairs")
def sort_pairs(spark, sf):
    return number_rows(_pairs(spark, sf).select("u", "v"), ["u", "v"], "place")


@_query("""select '{"All_barcodes_unfiltered":' || (select count(*) from mult) || ',"All_barcodes_filtered":' || (select count(*) from mult where mult between 550 and 650) || ',"Scaffold_end_barcodes":' ||
    (select count(distinct barcode) from imap) || ',"Min_barcode_reads_threshold":550,"Max_barcode_reads_threshold":650}' as value""")
def sink_barcode_stats_json(spark, sf):
    return sinks.barcode_stats_json(pr.count_barcodes(_imap(spark, sf), st.multiplicity(spark, sf), st.LOW, st.HIGH), st.LOW, st.HIGH)


@_query("select doc_id, round(count(kmer) / count(*), 9) fraction from canon group by doc_id")
def kmer_fraction(spark, sf):
    counts = _windows(spark, sf).groupBy("doc_id").agg(F.count("kmer").alias("found"), F.count("*").alias("total"))
    return counts.select("doc_id", F.round(sequence.kmer_fraction(F.col("found"), F.col("total")), 9).alias("fraction"))


@_query("select u, v, orientation, jaccard, distance from (select u, v, orientation, round(jaccard, 9) jaccard, distance, row_number() over (partition by u, v, orientation order by abs(jaccard - own), jaccard) k from (select *, barcodes_intersect / barcodes_union own from stats where barcodes_union > 0) cross join curve) where k = 1")
def topk_nearest(spark, sf):
    near = ds.nearest_points(_stats(spark, sf), _curve(spark, sf), 1)
    return near.select("u", "v", "orientation", F.round("jaccard", 9).alias("jaccard"), "distance")


@_query("select * from (values ('digraph distances {'), ('}')) t(value) union all select '\"' || contig || s || '\" [l=' || length || ']' from lens, (values ('+'), ('-')) t(s) union all select '\"' || src || ss || '\" -> \"' || dst || sd || '\" [d=100 e=100.0 n=' || weight || ']' as value from (select u src, case when orientation < 2 then '-' else '+' end ss, v dst, case when orientation % 2 = 1 then '-' else '+' end sd, weight from edges union all select v, case when orientation % 2 = 1 then '+' else '-' end, u, case when orientation < 2 then '+' else '-' end, weight from edges)")
def sink_dist_gv(spark, sf):
    return sinks.dist_gv_lines(gr.to_digraph(_edges(spark, sf)), st.lengths(spark, sf))


@_query("""select * from (values ('graph G {'), ('}')) t(value) union all select (k - 1) || ' [id=' || id || '];' from ids
    union all select (a.k - 1) || '--' || (b.k - 1) || ' [label=' || orientation || ', weight=' || weight || '];' from edges join ids a on a.id = u join ids b on b.id = v""")
def sink_gv(spark, sf):
    return sinks.gv_lines(_edges(spark, sf))


@_query("""select 'span' || chr(9) || cast(floor((sum(length(seq)) // 1000) * 0.25) as bigint) as value from solid union all
    select 'read_p90' || chr(9) || (a[greatest(case when n * 0.9 = floor(n * 0.9) then cast(floor(n * 0.9) as int) else cast(floor(n * 0.9) as int) + 1 end, 1)] + a[cast(floor(n * 0.9) as int) + 1]) // 2
    from (select list_sort(list(length(seq))) a, count(*) n from solid where length(seq) > 1000)""")
def sink_params(spark, sf):
    reads = st.solid_sequences(spark, sf)
    return sinks.param_lines(lr.span(reads, 1000, 0.25), lr.length_percentile(reads, 90))


@_query("select src_, dst_, cast(max(ceil(3 * e + 6)) as bigint) allowed from est_rows group by all")
def allowed_error(spark, sf):
    return _estimates(spark, sf, lambda rows, keys: rows.groupBy(*keys).agg(F.max(gr.allowed_error(F.col("e"), 6)).alias("allowed")))


@_query("""select src, dst, d, e, cast(total as bigint) n from (select *, row_number() over (partition by src, dst order by e, d desc) r, sum(n) over (partition by src, dst) total from (
    select src, dst, case when own then v when d0 is null then 1 - 25 else d0 end d, case when own then cast(x as double) when d0 is null then 0 else e0 end e, case when own then u when d0 is null then 0 else n0 end n from (
      select src, unnest(dsts) dst, own, v, x, u, d0, e0, n0 from (
        select (user_id % 40) || '+' src, case when event_id % 10 = 8 then [(event_id % 23) || '-', (event_id % 23 + 30) || '+'] else [(event_id % 23) || '-'] end dsts, event_id % 10 in (0, 1, 2, 9) own, event_id % 10 s,
          cast(floor(value) as int) % 100 - 20 v, event_id % 3 + 1 x, user_id % 10 u, last_value(case when s = 3 then v end ignore nulls) over w d0,
          last_value(case when s = 3 then cast(x as double) end ignore nulls) over w e0, last_value(case when s = 3 then u end ignore nulls) over w n0
        from events window w as (order by event_id)) where s <> 3))) where r = 1""")
def scan_dot(spark, sf):
    """A graph of events whose defaults change all along the file, written as one ordered file and read back."""
    i, user = F.col("event_id"), F.col("user_id")
    settings = F.concat(F.lit("[d="), F.floor("value") % 100 - 20, F.lit(" e="), F.format_string("%.1f", (i % 3 + 1).cast("double")), F.lit(" n="), user % 10, F.lit("]"))
    src, dst = F.concat(F.lit('"'), user % 40, F.lit('+"')), F.concat(F.lit('"'), i % 23, F.lit('-"'))
    edge = F.concat(src, F.lit(" -> "), dst)
    text = F.when(i % 10 == 3, F.concat(F.lit("edge "), settings)).when((i % 10).between(4, 7), edge)
    text = text.when(i % 10 == 8, F.concat(src, F.lit(" -> { "), dst, F.lit(' "'), i % 23 + 30, F.lit('+" }'))).otherwise(F.concat(edge, F.lit(" "), settings))
    ends = spark.createDataFrame([(0, 0, "digraph events {"), (0, 1, "graph [k=25]"), (2, 0, "}")], "part int, place long, value string")
    lines = st.table(spark, sf, "events").select(F.lit(1).alias("part"), i.alias("place"), text.alias("value")).unionByName(ends)
    path = f"{shared_folder(spark)}/events-{uuid.uuid4()}.dot"
    write_one_file(lines, path, ["part", "place"])
    return dot.read_dot(spark, path)[1].drop("file")


@_query("""select contig_id, reverse, cast(row_number() over (partition by contig_id, reverse order by target || strand || ',100,' || n || ',100.0') - 1 as int) place, target, strand target_strand, 100 d, n, 100.0::double e
    from (select u contig_id, orientation < 2 reverse, v target, case when orientation % 2 = 1 then '-' else '+' end strand, weight n from edges
      union all select v, orientation % 2 = 0, u, case when orientation < 2 then '+' else '-' end, weight from edges)""")
def estimate_record(spark, sf):
    """Distances of the graph as a line of estimates for each contig, written and read back."""
    rows = gr.to_digraph(_edges(spark, sf)).select(
        F.col("src").alias("contig_id"), (F.col("src_strand") == "-").alias("reverse"), F.lit(0).alias("place"), F.col("dst").alias("target"), F.col("dst_strand").alias("target_strand"), "d", "n", "e"
    )
    found = dot.read_estimates(spark, _written(spark, dot.estimate_lines(rows).select("value"), ".txt"))
    return found.drop("file", "ord")


@_query("""select l_orderkey path_id, count(*) n, cast(sum(100 + contig) + sum(coalesce(-(contig + last) % 50, 0)) as bigint) length, cast(sum(contig * 3) as bigint) coverage from (
    select *, lag(contig) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) last from (select *, l_partkey % 97 contig from lineitem)) group by l_orderkey""")
def contig_props(spark, sf):
    """Orders as paths over parts: the length and coverage of the paths along the edges between neighbouring parts, whose
    properties are read from text."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = st.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path_id"), (F.row_number().over(by) - 1).alias("place"), (F.col("l_partkey") % 97).alias("number"), F.lag(F.col("l_partkey") % 97).over(by).alias("last"))
    paths = lines.select("path_id", "place", F.col("number").cast("string").alias("contig"), F.lit("+").alias("strand"))
    text = F.concat(F.lit("l="), F.col("number") + 100, F.lit(" C="), F.col("number") * 3)
    contigs = lines.select("number").distinct().select(F.col("number").cast("string").alias("contig"), gr.properties(text).alias("p")).select("contig", "p.*")
    steps = lines.filter("last is not null").select("last", "number").distinct()
    edges = steps.select(F.col("last").cast("string").alias("src"), F.lit("+").alias("src_strand"), F.col("number").cast("string").alias("dst"), F.lit("+").alias("dst_strand"), (-((F.col("last") + F.col("number")) % 50)).cast("int").alias("d"))
    return gr.path_properties(paths, contigs, edges)


@_query("""select name, comment, anchor, substr(s, low, size) seq, substr(q, low, size) qual from (select *, case when lead_ = 32 then 1 else lead_ + 1 end low, case when lead_ = 32 then 1 else 32 - lead_ - trail end size from (
    select *, 32 - length(ltrim(bad, '0')) lead_, 32 - length(rtrim(bad, '0')) trail from (select name, comment, null::varchar anchor, case when kind = 0 and back then reverse(translate(base, 'ACGT', 'TGCA')) else base end s,
      case when kind = 0 and back then reverse(translate(h, '0123456789abcdef', '!"#$%&()*+,-./01')) else translate(h, '0123456789abcdef', '!"#$%&()*+,-./01') end q,
      case when kind = 0 and back then reverse(b) else b end bad from (
        select event_id % 3 kind, user_id % 2 = 0 back, md5('q' || event_id) h, translate(md5(cast(event_id as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') base, translate(h, '0123456789abcdef', '0000000000000111') b,
          case when kind = 0 then 'e' || event_id || '/' || (event_id % 2 + 1) when kind = 1 then 'm:1:' || event_id || ':5:6/' || (event_id % 2 + 1) else 'm:' || event_id || ':3:4:5#AC/2' end name,
          case when kind = 2 then '3:N:0:' else (event_id % 2 + 1) || ':N:0:' end comment
        from events where user_id % 5 <> 0 and not (event_id % 3 = 0 and user_id % 7 = 0)))))""")
def scan_fasta_rich(spark, sf):
    """Reads made of all events as alignment, qseq and export lines of one file, by the reader of all formats: rejected and
    secondary ones left out, turned ones turned back, cut to their good part, qualities written from 33."""
    i, user = F.col("event_id"), F.col("user_id")
    seq = F.translate(F.md5(i.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    codes = F.md5(F.concat(F.lit("q"), i.cast("string")))
    from_33, from_64 = (F.translate(codes, "0123456789abcdef", "".join(chr(base + x) for x in (*range(6), *range(7, 17)))) for base in (33, 64))
    tab = lambda *x: F.concat_ws("\t", *[v if not isinstance(v, str) else F.lit(v) for v in x])
    fails = user % 5 == 0
    flag = F.when(i % 2 == 0, 0x41).otherwise(0x81) + F.when(user % 2 == 0, 0x10).otherwise(0) + F.when(user % 7 == 0, 0x100).otherwise(0) + F.when(fails, 0x200).otherwise(0)
    aligned = tab(F.concat(F.lit("e"), i), flag.cast("string"), "c", "1", "60", "32M", "=", "1", "0", seq, from_33, "NM:i:0")
    qseq = tab("m", "1", "", i.cast("string"), "5", "6", "0", (i % 2 + 1).cast("string"), seq, from_64, F.when(fails, "0").otherwise("1"))
    export = tab("m", i.cast("string"), "3", "4", "5", "", "AC", "3", seq, from_64, *["x"] * 11, F.when(fails, "N").otherwise("Y"))
    text = F.when(i % 3 == 0, aligned).when(i % 3 == 1, qseq).otherwise(export)
    path = f"{shared_folder(spark)}/reads-{uuid.uuid4()}.sam"
    st.table(spark, sf, "events").select(text).write.text(path)
    return read_rich(spark, path, quality=14, convert_quality=True).drop("file", "ord")


@_query("""select cast(r.k as varchar) barcode, cast(c.k as varchar) contig, is_head, count(*) n from mate_best a join mate_best b on a.doc_id = b.doc_id and a.read_num = b.read_num and a.mate = 1 and b.mate = 2 and a.end_idx = b.end_idx
    join end_rows e on e.end_idx = a.end_idx join (select doc_id, row_number() over (order by doc_id) k from solid where seq is not null) r on r.doc_id = a.doc_id
    join (select doc_id, row_number() over (order by doc_id) k from solid where seq is not null) c on c.doc_id = e.contig group by all""")
def long_read_run(spark, sf):
    """All sequences written as one FASTA file that is both the draft and the long reads of a whole run; the counts of its
    barcodes on ends of contigs."""
    path = f"{shared_folder(spark)}/long-{uuid.uuid4()}.fa"
    write_one_file(st.solid_sequences(spark, sf).select("ord", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")), path, ["ord"], again=True)
    params = ScaffoldParams(file=path, inputs=(path,), kmer_mode=True, k_value=20, end_length=300, min_size=500)
    return Scaffolder(params).run_long(spark, cut=60, min_length=0).imap


def _new_path(spark, name: str) -> str:
    stem, _, end = name.rpartition(".")
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4()}.{end}"


def _alignment_files(spark, sf) -> list[str]:
    """All alignment rows in two text files with a header each: thousands of events by turns."""
    rows = st.alignments(spark, sf)
    columns = [F.col(c).cast("string") for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")]
    head = spark.createDataFrame([(-4 + i, f"@SQ\tSN:c{i}\tLN:400") for i in range(3)] + [(-1, "@PG\tID:x")], "ord long, value string")
    paths = []
    for name, own in (("a", F.col("ord") % 2000 < 1000), ("b", F.col("ord") % 2000 >= 1000)):
        paths.append(_new_path(spark, f"{name}.sam"))
        write_one_file(head.unionByName(rows.filter(own).select("ord", F.concat_ws("\t", *columns).alias("value"))), paths[-1], ["ord"])
    return paths


@_query("""select part, cast(3 + row_number() over (partition by part order by ord) as bigint) ord, qname, flag, rname, pos, mapq, ord % 10 || 'S' || (100 - ord % 10) || 'M' cigar, 100 n_bases, 'NM:i:' || ord % 4 || chr(9) || 'BX:Z:' || barcode tags
    from (select *, case when ord % 2000 < 1000 then 'a' else 'b' end part from pairs_raw)""")
def scan_sam(spark, sf):
    """All alignment rows, written to two files and read back in the order of each."""
    rows = read_alignments(spark, *_alignment_files(spark, sf))
    return rows.select(F.regexp_extract("file", r"/([ab])-[^/]*$", 1).alias("part"), "ord", "qname", "flag", "rname", "pos", "mapq", "cigar", F.length("seq").alias("n_bases"), "tags")


@_query("""select barcode, contig, mid_pos <= 150 is_head, count(*) n from (select barcode, r2 contig, (p1 + p2) // 2 mid_pos from (
    select *, max(last) over (partition by part) part_last from (select part, qname, count(*) n, max(ord) last, min_by(flag, ord) f1, max_by(flag, ord) f2, min_by(mapq, ord) m1, max_by(mapq, ord) m2, min_by(si, ord) s1, max_by(si, ord) s2,
      min_by(rname, ord) r1, max_by(rname, ord) r2, max_by(barcode, ord) barcode, min_by(pos, ord) p1, max_by(pos, ord) p2 from (select *, case when ord % 2000 < 1000 then 'a' else 'b' end part from pairs_raw) group by part, qname))
    where n = 2 and last < part_last and f1 in (99, 147) and f2 in (99, 147) and m1 <> 0 and m2 <> 0 and s1 >= 90 and s2 >= 90 and r1 = r2) where mid_pos <= 150 or mid_pos > 250 group by all""")
def scan_multi_file(spark, sf):
    """A whole run over two alignment files that a third one lists, with lengths from their headers; mates lie within one file."""
    listed = _new_path(spark, "inputs.txt")
    paths = spark.createDataFrame(list(enumerate(_alignment_files(spark, sf))), "ord long, value string")
    write_one_file(paths, listed, ["ord"])
    return Scaffolder(ScaffoldParams(fof_name=listed, seq_id=90, min_size=100, end_length=150)).run(spark).imap


@_query("select contig contig_id, length from lens")
def scan_sam_sq(spark, sf):
    """Lengths of contigs as the header of an alignment file, read back and held against them."""
    lengths = st.lengths(spark, sf)
    path = _new_path(spark, "header.sam")
    write_one_file(lengths.select("contig", F.concat(F.lit("@SQ\tM5:x\tSN:"), "contig", F.lit("\tLN:"), "length", F.lit("\tUR:y")).alias("value")), path, ["contig"])
    header = read_sam_header(spark, path)
    ct.validate_header(header, lengths)
    return header.drop("file")


@_query("select barcode, cast(mult as int) mult from mult")
def scan_barcode_mult(spark, sf):
    """Barcodes and how often they come, as a table in which each is listed twice: the last row counts."""
    path = _new_path(spark, "mult.csv")
    twice = st.multiplicity(spark, sf).select("barcode", F.posexplode(F.array(F.lit(1).cast("long"), "mult")))
    write_one_file(twice.select("pos", "barcode", F.concat_ws(",", "barcode", F.col("col").cast("string")).alias("value")), path, ["pos", "barcode"])
    return read_multiplicity(spark, path)


@_query("select u, v, orientation, weight from edges")
def scan_gv(spark, sf):
    """The scaffold graph, written and read back."""
    nodes, edges = graphs.read_gv(spark, _written(spark, sinks.gv_lines(_edges(spark, sf)).select("value"), ".txt"))
    return graphs.gv_edges(nodes, edges).drop("dist")


def _fasta_file(spark, rows, width: int) -> str:
    path = _new_path(spark, "draft.fa")
    lines = F.regexp_replace("seq", "(.{%d})" % width, "$1\n")
    write_one_file(rows.select("ord", F.concat(F.lit(">"), "name", F.lit(" x\n"), lines).alias("value")), path, ["ord"], again=True)
    return path


@_query("select cast(doc_id as varchar) contig, length(seq) length from solid where seq is not null")
def scan_fasta_lengths(spark, sf):
    """Lengths of all sequences, read from a FASTA file with lines of 70 letters."""
    return ct.contig_lengths(read_contigs(spark, _fasta_file(spark, st.solid_sequences(spark, sf), 70)))


@_query("""select row_number() over (order by r, file_no) - 1 place, file_no, "name", seq_md5 from (select cast(doc_id % 2 as int) file_no, row_number() over (partition by doc_id % 2 order by doc_id) r, cast(doc_id as varchar) "name", md5(seq) seq_md5 from solid where seq is not null)""")
def fasta_interleave(spark, sf):
    """Sequences of two FASTA files taken in turn."""
    rows = st.solid_sequences(spark, sf)
    files = [read_sequences(spark, _fasta_file(spark, rows.filter(F.col("doc_id") % 2 == i), 80)) for i in (0, 1)]
    return interleave(*files).select("place", "file_no", "name", F.md5("seq").alias("seq_md5"))


@_query("""select doc_id, read_num, translate(substr(seq, s, size), 'ACGT', '@>+I') fwd_qual, reverse(translate(substr(seq, case when read_num = whole then length(seq) - size + 1 else s + 250 end, size), 'ACGT', '@>+I')) rev_qual from (
    select *, case when read_num = whole then length(seq) - rest else read_num * 500 end + 1 s, case when read_num = whole then least(250, rest) else 250 end size from (
      select doc_id, seq, length(seq) // 500 whole, length(seq) % 500 rest, unnest(range(0, length(seq) // 500 + case when length(seq) % 500 = 0 then 0 else 1 end)) read_num from solid where length(seq) >= 500))""")
def lr_qual(spark, sf):
    """The qualities of the mates that all sequences are cut into; the second mate's are turned."""
    reads = st.solid_sequences(spark, sf).withColumns({"barcode": F.col("doc_id"), "qual": F.translate("seq", "ACGT", "@>+I")})
    return lr.cut_long_reads(reads, 250).select(F.col("barcode").alias("doc_id"), F.col("read_num").cast("long").alias("read_num"), "fwd_qual", "rev_qual")
