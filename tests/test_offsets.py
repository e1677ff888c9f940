"""Offsets of FASTA files, and streaks of k-mers, against plain restatements."""

import bisect
import random

import pytest

from scaffweave.operators import kmers as km
from scaffweave.sources import offsets as of
from scaffweave.sources import sequences as sq


def test_index_of_a_file_and_offsets_in_it(spark, tmp_path):
    rng = random.Random(2)
    records = [(f"c{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 30, 500])))) for i in range(60)]
    text = "".join(f">{name}{rng.choice(['', ' x y'])}\n{seq}\n" for name, seq in records)
    (tmp_path / "c.fa").write_text(text)
    index = of.offset_index(sq.read_records(spark, [str(tmp_path / "c.fa")]))
    got = index.orderBy("ord").collect()
    assert [(r.ord, r.contig_id, r["size"]) for r in got] == [(i, n, len(s)) for i, (n, s) in enumerate(records)]
    assert all(text[r.offset : r.offset + r["size"]] == s for r, (_, s) in zip(got, records, strict=True))
    begins = [r.offset for r in got]
    ask = [rng.randrange(len(text) + 50) for _ in range(400)] + [0, 5, 5]
    frame = spark.createDataFrame([(got[0].file, o, i) for i, o in enumerate([*ask, None])], "file string, offset long, tag int")
    for r in of.locate(index, frame).collect():
        at = bisect.bisect_right(begins, r.offset) - 1 if r.offset is not None else -1
        inside = at >= 0 and r.offset - begins[at] < got[at]["size"]
        assert (r.contig_id, r.position) == ((got[at].contig_id, r.offset - begins[at]) if inside else (None, None))
    assert of.locate(index, frame.limit(0)).count() == 0
    assert {r.contig_id for r in of.locate(index.limit(0), frame).collect()} == {None}


def test_index_as_text_and_back(spark, tmp_path):
    index = spark.createDataFrame([("f", 0, "a", 4, 3), ("f", 1, "b", 0, 11)], "file string, ord long, contig_id string, size long, offset long")
    lines = [r.value for r in of.fai_lines(index).orderBy("ord").collect()]
    assert lines == ["a\t4\t3\t4\t5", "b\t0\t11\t0\t1"]
    (tmp_path / "x.fai").write_text("\n".join([*lines, "c\t9\t20\t9\t9"]) + "\n")
    assert [tuple(r)[1:] for r in of.read_fai(spark, str(tmp_path / "x.fai")).orderBy("ord").collect()] == [(0, "a", 4, 3), (1, "b", 0, 11), (2, "c", 9, 20)]
    assert [r.value for r in of.sam_header_lines(index).orderBy("ord").collect()] == ["@SQ\tSN:a\tLN:4", "@SQ\tSN:b\tLN:0"]
    (tmp_path / "bad.fai").write_text("a\t100\t3\t60\t61\n")
    with pytest.raises(Exception, match="several lines"):
        of.read_fai(spark, str(tmp_path / "bad.fai")).collect()


def test_sequences_of_several_lines_have_no_index(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">a\nAC\nGT\n>b\nA\n")
    with pytest.raises(Exception, match="only sequence line"):
        of.offset_index(sq.read_records(spark, [str(tmp_path / "c.fa")])).collect()


@pytest.mark.parametrize("k,block", [(5, 1 << 14), (5, 16), (33, 50)])
def test_streaks(spark, monkeypatch, k, block):
    monkeypatch.setattr(km, "BLOCK", block)
    rng = random.Random(k)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    reads = [(i, "".join(c if rng.random() < 0.97 else rng.choice("ACGTN") for c in base[low : low + rng.randrange(30, 160)])) for i, low in enumerate(range(0, 300, 12))]
    reads += [(100, "A" * (k - 1)), (101, "N" * 80), (102, None), (103, base)]
    flip = str.maketrans("ACGT", "TGCA")
    canon = lambda w: min(w, w.translate(flip)[::-1]) if set(w) <= set("ACGT") else None
    known = {canon(base[i : i + k]) for i in range(len(base) - k + 1)}
    index = km.kmer_index(km.kmer_rows(spark.createDataFrame([(1, base)], "end_idx long, seq string"), "seq", k, ["end_idx"]))
    windows = km.kmer_rows(spark.createDataFrame(reads, "id long, seq string"), "seq", k, ["id"], place=True)
    got = {r.id: tuple(r)[1:] for r in km.streak_scores(windows, index, ["id"], k).collect()}
    want = {}
    for i, text in reads:
        hits = [canon(text[j : j + k]) in known for j in range(len(text) - k + 1)] if text else []
        if not hits:
            continue
        runs, n = [], 0
        for h in [*hits, False]:
            if h:
                n += 1
            elif n:
                runs.append(n)
                n = 0
        score = sum(x - 0.5 for x in runs)
        want[i] = (len(hits), sum(runs), len(runs), max((x + k - 1 for x in runs), default=0), score, score / len(hits))
    assert got == want
