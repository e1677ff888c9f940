import math
import random

import pytest
from pyspark.sql import functions as F

from scaffweave.functions.stats import grouped_quantile, swapped_quantile
from scaffweave.operators import alignments as al
from scaffweave.operators import checkpoint as ck
from scaffweave.operators import contigs as ct
from scaffweave.operators import distance as ds
from scaffweave.operators import graph as gr
from scaffweave.operators import kmers as km
from scaffweave.operators import longreads as lr
from scaffweave.operators import sinks
from scaffweave.params import ScaffoldParams
from scaffweave.plans.scaffolder import Scaffolder
from scaffweave.sources import graphs
from scaffweave.sources import sequences as sq

EDGES = "u string, v string, orientation int, weight int"


def state_machine(names):
    """Pairs of neighbours of one name; three in a row are dropped; the last name is never completed."""
    groups, out = [], []
    for n in names:
        if groups and groups[-1][0] == n:
            groups[-1][1] += 1
        else:
            groups.append([n, 1])
    for n, count in groups[:-1]:
        if count == 2:
            out.append(n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_join_mates_is_the_state_machine(spark, seed):
    rng = random.Random(seed)
    names = [f"r{i}" for i in range(30) for _ in range(rng.choice([1, 2, 2, 3]))]
    rows = spark.createDataFrame([("f", i, n, rng.randrange(100)) for i, n in enumerate(names)], "file string, ord long, qname string, pos int")
    assert sorted(r["qname"] for r in al.join_mates(rows).collect()) == sorted(state_machine(names))
    assert {r["qname"] for r in al.join_mates(rows, compat=False).collect()} >= set(state_machine(names))


def mate_runs(rows, compat):
    """(file, name, place of the first, place of the second) of the reader, record by record."""
    out = []
    for file in {r[0] for r in rows}:
        own = sorted((o, n) for f, o, n in rows if f == file)
        begin = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][1] != own[begin][1]:
                if i - begin == 2 and not (compat and i == len(own)):
                    out.append((file, own[begin][1], own[begin][0], own[begin + 1][0]))
                begin = i
    return sorted(out, key=repr)


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1 << 17])
@pytest.mark.parametrize("compat", [True, False])
def test_mates_are_neighbours_where_names_recur(spark, monkeypatch, stretch, compat):
    monkeypatch.setattr(al, "STRETCH", stretch)
    rng = random.Random(stretch)
    names = {"f": list("xxyyxxzze"), "g": [rng.choice("abc") for _ in range(120)], "h": list("aa"), "i": ["a"], "j": [None, None, "a", "a", "a", None, None, "b", "b"]}
    rows = [(f, 3 * i + rng.randrange(3), n) for f, own in names.items() for i, n in enumerate(own)]
    frame = spark.createDataFrame([(*r, r[1] * 2) for r in rows], "file string, ord long, qname string, pos long").repartition(3)
    got = al.join_mates(frame, compat).collect()
    assert sorted(((r.file, r.qname, r["first"].ord, r.second.ord) for r in got), key=repr) == mate_runs(rows, compat)
    assert all(r["first"].pos == 2 * r["first"].ord for r in got)
    assert [r.qname for r in sorted((r for r in got if r.file == "f"), key=lambda r: r["first"].ord)] == list("xyxz")
    assert al.join_mates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("own,k,expected", [(2.5, 1, [2]), (2.5, 2, [2, 3]), (0.0, 2, [1, 2]), (5.0, 2, [3, 4]), (3.0, 1, [3])])
def test_nearest_points(spark, own, k, expected):
    curve = spark.createDataFrame([(i / 10, i) for i in (1, 2, 3, 4)], "jaccard double, distance int")
    stats = spark.createDataFrame([("a", "b", 0, int(own * 10), 100)], "u string, v string, orientation int, barcodes_intersect int, barcodes_union int")
    assert sorted(r["distance"] for r in ds.nearest_points(stats, curve, k).collect()) == expected


def test_nearest_points_equal_brute_force(spark):
    rng = random.Random(3)
    points = sorted({rng.randrange(1000) / 1000 for _ in range(60)})
    curve = spark.createDataFrame([(p, i) for i, p in enumerate(points)], "jaccard double, distance int")
    asked = [("a", str(i), 0, rng.randrange(1001), 1000) for i in range(50)]
    stats = spark.createDataFrame(asked, "u string, v string, orientation int, barcodes_intersect int, barcodes_union int")
    found = {}
    for r in ds.nearest_points(stats, curve, 7).collect():
        found.setdefault(r["v"], set()).add(r["jaccard"])
    for _, v, _, x, n in asked:
        assert found[v] == set(sorted(points, key=lambda p: (abs(p - x / n), -p))[:7])


def test_distances_equal_brute_force_where_one_score_has_most_rows(spark):
    rng = random.Random(9)
    points = sorted({rng.randrange(1, 1000) / 1000 for _ in range(40)})
    curve = spark.createDataFrame([(p, rng.randrange(5000)) for p in points], "jaccard double, distance int")
    at = {r.jaccard: r.distance for r in curve.collect()}
    asked = [("a", str(i), i % 4, 0 if i % 3 else rng.randrange(1001), 0 if i % 17 == 0 else 1000) for i in range(120)]
    rows = spark.createDataFrame(asked, "u string, v string, orientation int, barcodes_intersect int, barcodes_union int")
    k, expected = 6, {}
    for _, v, _, x, n in asked:
        if n:
            d = sorted(at[p] for p in sorted(points, key=lambda p: (abs(p - x / n), -p))[:k])
            low, mid, high = (s * d[math.floor(q * 5)] + (1 - s) * d[math.ceil(q * 5)] for q in (0.01, 0.5, 0.99) for s in [q * 5 - math.floor(q * 5)])
            expected[v] = (math.floor(low), math.floor(mid + 0.5), math.ceil(high), x / n)
    fields = ("min_dist", "dist", "max_dist", "jaccard")
    assert {r.v: tuple(r[f] for f in fields) for r in ds.estimate_distances(rows, curve, k).collect()} == expected
    edges = spark.createDataFrame([(*r[:3], 1) for r in asked] + [("x", "y", 0, 2), ("x", None, 1, 3)], EDGES)
    found = ds.edges_with_distances(edges, rows, curve, k).collect()
    assert len(found) == 122
    assert {r.v: tuple(r[f] for f in fields) for r in found if r.jaccard is not None} == expected
    bare = ds.edges_with_distances(edges, rows, curve.limit(0), k).collect()
    assert len(bare) == 122 and all(r.dist is None for r in bare)
    assert ds.estimate_distances(rows, curve.limit(0), k).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.01, 0.3, 0.5, 1.0])
def test_quantiles_of_groups_equal_those_of_lists(spark, q):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(6)) for _ in range(90)] + [("d", 7), ("e", None), ("f", 2), ("f", None), (None, 1), (None, 4)]
    frame = spark.createDataFrame(rows, "k string, x long")
    got = {r.k: r.q for r in grouped_quantile(frame, ["k"], "x", q).collect()}
    lists = frame.filter("x is not null").groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("d"))
    assert got == {r.k: pytest.approx(r.q) for r in lists.select("k", swapped_quantile(F.col("d"), q).alias("q")).collect()}


def test_digraph_of_the_long_read_demo(spark):
    edges = spark.createDataFrame([("1", "2", 3, 5), ("2", "3", 1, 4)], EDGES)
    got = {(r.src + r.src_strand, r.dst + r.dst_strand, r.d, r.n) for r in gr.to_digraph(edges, 100).collect()}
    assert got == {("3+", "2+", 100, 4), ("2+", "1-", 100, 5), ("2-", "3-", 100, 4), ("1+", "2-", 100, 5)}


def test_checkpoint_rows(spark):
    edges = spark.createDataFrame([("1", "2", 2, 15), ("2", "3", 2, 28)], EDGES)
    numbers = spark.createDataFrame([(str(i), i) for i in (1, 2, 3)], "contig string, number int")
    got = {tuple(r) for r in ck.checkpoint_rows(edges, numbers).collect()}
    assert got == {(10, "f1", "f2", 15, 1500), (10, "r2", "r1", 15, 1500), (10, "f2", "f3", 28, 2800), (10, "r3", "r2", 28, 2800)}
    sized = spark.createDataFrame([("1", "2", 0, 2, d) for d in (-5, 0, 499, 500, 1000, 5000, None)], EDGES + ", dist int")
    rows = ck.checkpoint_rows(sized, numbers, "dist").collect()
    assert sorted({(r.category, r.gap) for r in rows}) == [(-1, -10), (10, 200), (500, 0), (500, 998), (1000, 1000), (5000, 2000), (10000, 10000)]


def test_degree_filter_looks_once(spark):
    edges = spark.createDataFrame([("a", x, 0, 3) for x in "bcd"] + [("d", "e", 0, 3)], EDGES)
    assert [(r.u, r.v) for r in gr.remove_high_degree(edges, 2).collect()] == [("d", "e")]
    assert gr.remove_high_degree(edges, 0).count() == 4


def test_graph_files_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("1", "2", 2, 15), ("2", "3", 2, 28)], EDGES)
    path = str(tmp_path / "g.gv")
    sinks.write_lines(sinks.gv_lines(edges).coalesce(1), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ["graph G {", "0 [id=1];", "1 [id=2];", "2 [id=3];", "0--1 [label=2, weight=15];", "1--2 [label=2, weight=28];", "}"]
    back = graphs.gv_edges(*graphs.read_gv(spark, path))
    assert sorted(map(tuple, back.select("u", "v", "orientation", "weight").collect())) == [("1", "2", 2, 15), ("2", "3", 2, 28)]
    lengths = spark.createDataFrame([("1", 10), ("2", 20), ("3", 30)], "contig string, length int")
    path = str(tmp_path / "d.gv")
    sinks.write_lines(sinks.dist_gv_lines(gr.to_digraph(edges), lengths).coalesce(1), path)
    nodes, back = graphs.read_dist_gv(spark, path)
    assert nodes.count() == 6 and back.count() == 4 and {r.e for r in back.collect()} == {100.0}


def test_kmer_rows_jump(spark):
    rows = spark.createDataFrame([(1, "ACGTNACGT")], "id int, seq string")
    n = lambda jump: km.kmer_rows(rows, "seq", 4, ["id"], jump).agg(F.count("*"), F.count("kmer")).first()
    assert tuple(n(False)) == (6, 2) and tuple(n(True)) == (3, 2)


def test_long_read_cutter(spark):
    reads = spark.createDataFrame([("f", 0, "a", "ACGTACGTAC"), ("f", 1, "b", "ACGTACGT"), ("f", 2, "c", "ACG")], "file string, ord long, name string, seq string")
    numbered = lr.long_read_barcodes(reads)
    got = sorted((r.name, r.read_num, r.fwd, r.rev, r.fwd_qual) for r in lr.cut_long_reads(numbered, 2).collect())
    assert got == [("a", 0, "AC", "AC", "##"), ("a", 1, "AC", "AC", "##"), ("a", 2, "AC", "GT", "##"), ("b", 0, "AC", "AC", "##"), ("b", 1, "AC", "AC", "##")]
    assert {(r.barcode, r.n) for r in lr.pseudo_multiplicity(numbered, 2).collect()} == {(1, 6), (2, 4)}
    text = sinks.pseudo_read_lines(lr.cut_long_reads(numbered, 2)).first().value.split("\n")
    assert text[0] == "@a_f0 BX:Z:1" and len(text) == 8


def test_long_read_cutter_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(lr, "AT_ONCE", 300)
    rng = random.Random(8)
    reads = [(i, "".join(rng.choice("ACGTN") for _ in range(n)), rng.choice([None, "", "".join(rng.choice("IJ#") for _ in range(n))])) for i, n in enumerate([0, 19, 20, 21, 25, 39, 40, 41, 55, 60, 400, 1999])]
    flip = str.maketrans("ACGTN", "TGCAN")
    want = []
    for i, s, q in reads:
        q = q or "#" * len(s)
        for k in range(-(-len(s) // 20) if len(s) >= 20 else 0):
            rest = len(s) - 20 * k
            z = min(10, rest)
            at = 20 * k + 10 if rest >= 20 else len(s) - z
            want.append((i, k, s[20 * k :][:z], s[at:][:z].translate(flip)[::-1], q[20 * k :][:z], q[at:][:z][::-1]))
    frame = spark.createDataFrame(reads, "barcode long, seq string, qual string")
    got = [(r.barcode, r.read_num, r.fwd, r.rev, r.fwd_qual, r.rev_qual) for r in lr.cut_long_reads(frame, 10).collect()]
    assert sorted(got) == sorted(want)


def test_cutting_grows_with_the_length_of_a_read(spark):
    """One read of 20 million letters is cut as fast as many short ones, but for a small factor."""
    import time

    def took(length, n):
        rows = spark.range(n).select(F.col("id").alias("barcode"), F.repeat(F.lit("ACGTTGCAAC"), length // 10).alias("seq")).repartition(1)
        began = time.time()
        assert lr.cut_long_reads(rows, 250, fasta=True).agg(F.sum(F.length("fwd"))).first()[0] == n * length // 2
        return time.time() - began

    took(100_000, 20)
    assert took(20_000_000, 1) < 5 * took(100_000, 200) + 2


def test_sources(spark, tmp_path):
    fa = tmp_path / "c.fa"
    fa.write_text(">c1 first one\nACGT\nAC\n>c2\n" + "A" * 600 + "\n>c3 x>y\nACGN\n")
    rows = [tuple(r) for r in sq.read_contigs(spark, str(fa)).orderBy("ord").select("ord", "contig_id", "comment", "length").collect()]
    assert rows == [(0, "c1", "first one", 6), (1, "c2", "", 600), (2, "c3", "x>y", 4)]
    assert ct.count_valid_contigs(sq.read_contigs(spark, str(fa)), 5).first().n_contigs == 2
    fq = tmp_path / "r.fq"
    fq.write_text("".join(f"@r{i // 2}/{i % 2 + 1} BX:Z:AC-1\nACGTA\n+\n@####\n" for i in range(4)))
    rows = [tuple(r) for r in sq.read_fastq(spark, str(fq)).orderBy("ord").select("ord", "name", "comment", "seq", "qual").collect()]
    assert rows[1] == (1, "r0/2", "BX:Z:AC-1", "ACGTA", "@####") and len(rows) == 4
    sq.register(spark)
    wrapped = [tuple(r) for r in spark.read.format("sequences").load(str(fq)).orderBy("ord").select("ord", "name", "comment", "seq", "qual").collect()]
    assert wrapped == rows
    pairs = km.read_pairs(sq.read_fastq(spark, str(fq))).collect()
    assert [(p.pair, p.barcode) for p in sorted(pairs)] == [(0, "AC-1"), (1, "AC-1")]
    csv = tmp_path / "m.csv"
    csv.write_text("A,5\nB,7\n,3\nA,6\n")
    assert {tuple(r) for r in sq.read_multiplicity(spark, str(csv)).collect()} == {("A", 6), ("B", 7)}
    assert sq.detect_format(["a.sam", "b.bam"]) == "alignments" and sq.detect_format(["a.fq.gz"]) == "reads"
    for bad in (["a.sam", "b.fq"], ["a.fa"]):
        with pytest.raises(ValueError):
            sq.detect_format(bad)


def sam(tmp_path, pairs):
    lines = ["@SQ\tSN:1\tLN:1000", "@SQ\tSN:2\tLN:1000"]
    n = 0
    for barcode, contig, pos, count in pairs:
        for _ in range(count):
            for flag in (99, 147):
                lines.append(f"r{n}\t{flag}\t{contig}\t{pos}\t60\t100M\t=\t{pos}\t0\t{'A' * 100}\t*\tNM:i:0\tBX:Z:{barcode}-1")
            n += 1
    lines.append(f"last\t4\t*\t0\t0\t*\t*\t0\t0\t{'A' * 100}\t*\t")
    path = tmp_path / "a.sam"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scaffolder_alignment_mode(spark, tmp_path):
    path = sam(tmp_path, [(b, c, pos, 6) for b in "ABCDE" for c, pos in (("1", 950), ("2", 20))])
    p = ScaffoldParams(inputs=(path,), min_mult=1, end_length=300, min_size=500, base_name=str(tmp_path / "out"), output_pair=True, barcode_counts=str(tmp_path / "bc"))
    s = Scaffolder(p)
    result = s.run(spark)
    assert [tuple(r) for r in result.edges.collect()] == [("1", "2", 2, 5)]
    assert {(r.barcode, r.mult) for r in result.mult.collect()} == {(f"{b}-1", 24) for b in "ABCDE"}
    s.write(result)
    rows = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out_main.tsv")).collect()
    assert {(r.U, r.V, r.Best_orientation, r.Shared_barcodes) for r in rows} == {("1+", "2+", "T", "5"), ("2-", "1-", "T", "5")}


def test_scaffolder_kmer_mode(spark, tmp_path):
    rng = random.Random(1)
    contigs = ["".join(rng.choice("ACGT") for _ in range(1000)) for _ in range(2)]
    (tmp_path / "c.fa").write_text("".join(f">{i + 1}\n{c}\n" for i, c in enumerate(contigs)))
    out = []
    for b in "ABCDE":
        for c, low in ((0, 800), (1, 0)):
            for k in range(6):
                part = contigs[c][low + 10 * k : low + 10 * k + 100]
                out += [f"@{b}{c}{k}/{m} BX:Z:{b}\n{part}\n+\n{'#' * 100}\n" for m in (1, 2)]
    (tmp_path / "r.fq").write_text("".join(out))
    p = ScaffoldParams(inputs=(str(tmp_path / "r.fq"),), file=str(tmp_path / "c.fa"), kmer_mode=True, min_mult=1, end_length=300)
    assert [tuple(r) for r in Scaffolder(p).run(spark).edges.collect()] == [("1", "2", 2, 5)]


def test_distances_on_toy_counts(spark):
    rows = [(f"b{i}", c, h, 5) for i in range(6) for c in ("x", "y") for h in (True, False) if (i + (c == "y") + h) % 3]
    imap = spark.createDataFrame(rows, "barcode string, contig string, is_head boolean, n int")
    lengths = spark.createDataFrame([("x", 100), ("y", 120)], "contig string, length int")
    samples = {r.contig_id: r for r in ds.distance_samples(imap, lengths, 20, 5).collect()}
    assert samples["x"].distance == 60 and samples["x"].barcodes_union == 6
    assert ds.distance_samples(imap, lengths, 55, 5).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_kmer_counters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    ends = [(i + 1, "".join(rng.choice("ACGTN" if i == 2 else "ACGT") for _ in range(120))) for i in range(6)]
    ends.append((7, ends[0][1][20:80]))
    flip = str.maketrans("ACGT", "TGCA")
    held, total, removed, taken = {}, 0, 0, {}
    for end, text in ends:
        i = 0
        while i + 5 <= len(text):
            w = text[i : i + 5]
            if set(w) <= set("ACGT"):
                key = min(w, w.translate(flip)[::-1])
                total += 1
                first = taken.setdefault(key, end)
                held.setdefault(key, set()).add(end)
                removed += end != first
                i += 1
            else:
                i += 5
    rows = spark.createDataFrame(ends, "end_idx long, seq string")
    got = km.kmer_counters(km.kmer_index(km.kmer_rows(rows, "seq", 5, ["end_idx"], jump=True))).first()
    assert (got.n_recorded, got.n_collisions, got.n_unique, got.n_removed) == (len(held), total - len(held), sum(len(x) == 1 for x in held.values()), removed)


def jumping(text, k):
    out, i = [], 0
    while i + k <= len(text):
        w = text[i : i + k].upper()
        good = set(w) <= set("ACGT")
        out.append(min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) if good else None)
        i += 1 if good else k
    return out


@pytest.mark.parametrize("k", [1, 5, 12, 31, 32, 33, 47, 62, 63, 95])
def test_kmer_rows_equal_brute_force(spark, monkeypatch, k):
    """All windows and jumping ones, in one long and in two, over blocks, long breaks, small letters and other letters."""
    monkeypatch.setattr(km, "BLOCK", 40)
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTacgtN" if i % 2 else "ACGT") for _ in range(rng.randrange(0, 200))) for i in range(12)]
    texts += ["A" * 50 + "N" * 70 + "CCGT" * 20, "N" * 90, "é" * 40 + "ACGT" * 30, "", None, "GATTACA " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")

    def shown(x):
        if x is None or isinstance(x, str):
            return x
        if k > km.PACKED:
            return "".join(letters(v, k - km.PACKED * (len(x) - 1) if i == 0 else km.PACKED) for i, v in enumerate(x))
        return letters(x, k)

    def letters(x, n):
        return "".join("ACGT"[x >> 2 * i & 3] for i in reversed(range(n)))

    for jump in (False, True):
        got = {}
        for r in km.kmer_rows(rows, "seq", k, ["id"], jump).collect():
            got.setdefault(r.id, []).append(shown(r.kmer))
        for i, text in enumerate(texts):
            text = text or ""
            want = jumping(text, k) if jump else [jumping(text[j : j + k], k)[0] for j in range(len(text) - k + 1)]
            assert sorted(got.get(i, []), key=str) == sorted(want, key=str), (i, jump)


def test_packing_over_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(km, "AT_ONCE", 37)
    text = "ACGTNACCGTTNNNNNNNNNNNACGT" * 20
    for jump in (False, True):
        valid = [v for _, _, valid in km._packed(pa.array([text]), 7, jump) for v in valid.tolist()]
        want = jumping(text, 7) if jump else [jumping(text[j : j + 7], 7)[0] for j in range(len(text) - 6)]
        assert valid == [w is not None for w in want]


@pytest.mark.parametrize("k", [12, 40])
def test_index_of_long_kmers(spark, k):
    """Letters of packed k-mers, and a read that is placed by them on the end that it was cut from."""
    rng = random.Random(k)
    ends = [(i + 1, "".join(rng.choice("ACGT") for _ in range(300))) for i in range(4)]
    frame = spark.createDataFrame(ends, "end_idx long, seq string")
    rows = km.kmer_rows(frame, "seq", k, ["end_idx"])
    got = {r.text for r in rows.select(km.kmer_letters(F.col("kmer"), k).alias("text")).collect()}
    assert got == {jumping(t[j : j + k], k)[0] for _, t in ends for j in range(301 - k)}
    reads = spark.createDataFrame([(7, ends[2][1][50:200]), (8, "N" * 100), (9, ends[0][1][:60] + ends[1][1][:99])], "read long, seq string")
    best = km.best_contig(km.kmer_rows(reads, "seq", k, ["read"]), km.kmer_index(rows), 0.1, ["read"])
    assert {(r.read, r.end_idx, r.cnt) for r in best.collect()} == {(7, 3, 151 - k), (9, 2, 100 - k)}


def test_fasta_index_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(f, i, f"c{i}", rng.randrange(1, 50)) for f in ("a", "b") for i in range(40)]
    got = {(r.file, r.ord): r.begin for r in sq.fasta_index(spark.createDataFrame(rows, "file string, ord long, contig_id string, length int").repartition(7)).collect()}
    for f in ("a", "b"):
        at = 0
        for _, i, _, n in [r for r in rows if r[0] == f]:
            assert got[f, i] == at
            at += n


def test_records_keep_their_numbers_over_splits(spark, tmp_path):
    """Lines of several files and many splits are numbered in order."""
    for name, n in (("a.txt", 500), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sq.read_records(spark, [str(tmp_path / f"{x}.txt") for x in "abc"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.ord) for r in got) == sorted((f"{n} {i}", i) for n, k in (("a.txt", 500), ("b.txt", 3)) for i in range(k))


def test_scaffolder_refuses_what_it_cannot_read(spark):
    for params in (ScaffoldParams(), ScaffoldParams(inputs=("a.bam",)), ScaffoldParams(inputs=("a.fq",)), ScaffoldParams(inputs=("a.sam",), file="c.fa", kmer_mode=True)):
        with pytest.raises(ValueError):
            Scaffolder(params).run(spark)


def test_parameters_are_appended(spark, tmp_path):
    path = str(tmp_path / "params")
    one_row = spark.createDataFrame([(7, None)], "span long, read_p50 long")
    sinks.append_params(sinks.param_lines(one_row), path)
    sinks.append_params(sinks.param_lines(spark.createDataFrame([(1200,)], "read_p90 long")), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["read_p90\t1200", "span\t7"]


@pytest.mark.parametrize("rows,bad", [([("a", 5)], None), ([], None), ([("a", 5), ("c", 1)], "c"), ([("b", 9)], "b"), ([("a", None)], "a")])
def test_a_header_is_held_against_the_draft(spark, rows, bad):
    lengths = spark.createDataFrame([("a", 5), ("b", 8)], "contig string, length int")
    header = spark.createDataFrame([("f", *r) for r in rows], "file string, contig_id string, length int")
    if bad is None:
        ct.validate_header(header, lengths)
    else:
        with pytest.raises(ValueError, match=f"unexpected sequence {bad} "):
            ct.validate_header(header, lengths)


def test_listed_inputs(spark, tmp_path):
    listed, none = tmp_path / "inputs.txt", tmp_path / "none.txt"
    listed.write_text("b.sam\n\n  a.sam \nc.sam")
    none.write_text("\n")
    assert sq.read_fof(spark, str(listed)) == ["b.sam", "a.sam", "c.sam"]
    with pytest.raises(ValueError, match="lists no files"):
        sq.read_fof(spark, str(none))


def test_interleaved_files_of_different_lengths(spark):
    shape = "file string, ord long, name string"
    one = spark.createDataFrame([("x", 5 * i, f"x{i}") for i in range(4)], shape).repartition(3)
    two = spark.createDataFrame([("y", i, f"y{i}") for i in range(2)], shape)
    got = sorted((r.place, r.name) for r in sq.interleave(one, two, two.limit(0)).collect())
    assert got == list(enumerate(["x0", "y0", "x1", "y1", "x2", "x3"]))


@pytest.mark.parametrize("k", [5, 12, 20, 33])
def test_windows_are_compared_as_stretches(spark, monkeypatch, k):
    """Hits of stretches equal those of the index of single windows, on Spark and in small portions: other letters, copies of
    ends and reads, other strands, runs of one letter."""
    import pyarrow as pa

    rng = random.Random(k)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    texts = [letters(150) for _ in range(6)] + [letters(120, "ACGTacgtN") for _ in range(3)] + ["A" * 90 + letters(30), "AC" * 60, letters(k - 1), "", None, "é" * 30 + letters(60)]
    texts += [texts[0], texts[0][40:] + texts[1][:60], texts[2].translate(str.maketrans("ACGT", "TGCA"))[::-1][:90]]
    own = [t[i : i + 70] for t in texts if t for i in range(0, max(1, len(t) - 40), 25)] + ["N" * 40, None, "A" * 200]
    own += [t.translate(str.maketrans("ACGT", "TGCA"))[::-1] for t in own[:20]]
    ends = spark.createDataFrame(list(enumerate(texts, 1)), "end_idx long, end_seq string")
    reads = spark.createDataFrame([(i, None if i % 5 == 0 else f"b{i % 3}", t) for i, t in enumerate(own)], "id long, b string, seq string")
    index = km.kmer_index(km.kmer_rows(ends, "end_seq", k, ["end_idx"], jump=True)).filter("end_idx <> 0")
    rows = km.kmer_rows(reads, "seq", k, ["id", "b"]).join(index.select("kmer", "end_idx"), "kmer").groupBy("id", "b", "end_idx").agg(F.count("*").alias("cnt"))
    want = {tuple(r) for r in rows.collect()}
    got = km.end_hits(ends, reads, "seq", k, ["id", "b"]).groupBy("id", "b", "end_idx").agg(F.sum("cnt").alias("cnt"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20

    for name, x in (("PLACES", 3), ("DEALT", 40), ("COMPARED", 60), ("MERGED", 50), ("AT_ONCE", 97)):
        monkeypatch.setattr(km, name, x)
    dealt = []
    for side, frame in ((0, ends.select("end_seq", "end_idx")), (1, reads.select("seq", "id", "b"))):
        dealt += [r for batch in km._deal(k, side == 0, side)(iter(frame.toArrow().to_batches())) for r in batch.to_pylist()]
    dealt.sort(key=lambda r: (r["place"], r["side"]))
    few = pa.RecordBatch.from_pylist(dealt, schema=pa.schema([("place", pa.int32()), ("side", pa.int32()), ("size", pa.int32()), ("data", pa.binary())]))
    counts = {}
    for batch in km._compare(k)(few.slice(i, 7) for i in range(0, few.num_rows, 7)):
        for r in batch.to_pylist():
            key = r["id"], r["b"], r["end_idx"]
            counts[key] = counts.get(key, 0) + r["cnt"]
    assert {(*key, n) for key, n in counts.items()} == want and len({r["place"] for r in dealt}) <= 3


def test_windows_dealt_are_few_bytes_each():
    import pyarrow as pa

    rng = random.Random(4)
    text = pa.array(["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(20000)])
    rows = pa.RecordBatch.from_arrays([text, pa.array(range(20000))], names=["__seq", "id"])
    size = sum(len(x) for batch in km._deal(20, False, 1)(iter([rows])) for x in batch.column(3).to_pylist())
    assert size < 4 * 41 * 20000  # a row a window has its k-mer of 8 bytes alone


def test_interleaving_moves_records_once(spark):
    """Places are told from counts: three files of several lengths in one pass of each, gaps in their numbers."""
    shape = "file string, ord long, name string"
    sizes = (7, 0, 12, 4)
    frames = [spark.createDataFrame([(f"f{k}", 3 * i + k, f"{k}-{i}") for i in range(n)], shape).repartition(5) for k, n in enumerate(sizes)]
    out = sq.interleave(*frames)
    want = [f"{k}-{i}" for i in range(max(sizes)) for k, n in enumerate(sizes) if i < n]
    assert [(r.place, r.name) for r in sorted(out.collect(), key=lambda r: r.place)] == list(enumerate(want))
    # records stay where they were numbered: only counts are joined to them
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_fasta_of_odd_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">a b c\r\nAC GT\r\n\r\nGG\n>\n>b\n>c\td\nA\tC\x0bG\n\nT>T\n>\xc3\xa9 x\nNN")
    got = sorted((r.ord, r.name, r.comment, r.seq) for r in sq.read_fasta(spark, str(tmp_path / "x.fa")).collect())
    assert [x[1:] for x in got] == [("a", "b c", "ACGTGG"), ("b", "", ""), ("c", "d", "ACGT>T"), ("é", "x", "NN")]


def test_ends_are_cut_before_they_are_numbered(spark):
    """What is saved for the numbers holds the ends, not the sequences."""
    from scaffweave.operators import contigs as ct

    rows = spark.createDataFrame([("f", 7 * i, f"c{i}", "ACGT" * 50 + "G" * i) for i in range(9)], "file string, ord long, contig_id string, seq string").repartition(4)
    got = sorted(tuple(r) for r in ct.contig_ends(rows, 203, 30).collect())
    assert got == [x for k, i in enumerate(range(3, 9), 1) for x in ((2 * k - 1, f"c{i}", True, ("ACGT" * 8)[:30]), (2 * k, f"c{i}", False, ("ACGT" * 50 + "G" * i)[-30:]))]
    assert "seq#" not in ct.contig_ends(rows, 203, 30)._jdf.queryExecution().analyzed().toString().replace("end_seq#", "")


def test_keys_of_stretches_take_few_bytes():
    """Steps of keys and no places of letters: with four keys a stretch takes not much more than its letters; and it is had back."""
    import pyarrow as pa

    rng = random.Random(4)
    text = pa.array(["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(40000)])
    keys = {"file": [""] * 40000, "pair": [i // 2 % 30 for i in range(40000)], "barcode": [2**40 + i // 60 for i in range(40000)], "mate": [i % 2 + 1 for i in range(40000)]}
    rows = pa.RecordBatch.from_arrays([text, *map(pa.array, keys.values())], names=["__seq", *keys])
    dealt = [x for batch in km._deal(20, False, 1)(iter([rows])) for x in batch.to_pylist()]
    letters = sum(int(((windows + 22) // 4).sum()) for _, _, windows, _ in km._stretches(text, 20, False))
    assert sum(len(x["data"]) for x in dealt) < 2 * letters
    parts = [km._parted(pa.decompress(x["data"], decompressed_size=x["size"], codec="zstd"), 20) for x in dealt]
    assert sum(pa.compute.sum(p.column("__windows")).as_py() for p in parts) == 41 * 40000
    want = set(zip(*keys.values(), strict=True))
    assert {tuple(r.values())[:4] for p in parts for r in p.to_pylist()} == want


@pytest.mark.parametrize("kind", ["int8", "int16", "int32", "int64"])
def test_stretches_come_back_as_they_were(kind):
    import pyarrow as pa

    top = 2 ** (int(kind[3:]) - 1)
    columns = [pa.array([7, top - 1, -top, 0, top - 1], kind), pa.array([1, None, 2, 3, 4], kind), pa.array(["x", None, "é", "", "x"]), pa.array([{"a": 1, "b": "c"}] * 5)]
    windows = pa.array([1, 3, 5, 1, 70000], pa.int32())
    letters = pa.array([bytes([i]) * ((w + 22) // 4) for i, w in enumerate(windows.to_pylist())], pa.binary())
    rows = pa.RecordBatch.from_arrays([*columns, windows, letters], names=["n", "some", "text", "both", "__windows", "__letters"])
    for part in (rows, rows.slice(1), rows.slice(2, 1)):
        assert km._parted(pa.py_buffer(km._joined(part.columns, part.schema.names)), 20).equals(part)
