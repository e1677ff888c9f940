"""A whole run over long reads, from cutter to graph and files."""

import os
import random

import pytest

from scaffweave.params import ScaffoldParams
from scaffweave.plans.scaffolder import Scaffolder

FLIP = str.maketrans("ACGT", "TGCA")


def test_from_long_reads_to_the_graph_and_its_files(spark, tmp_path):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(12000))
    # three contigs of a genome, the middle one on its other strand, with gaps between them
    parts = [genome[:3900], genome[4000:7900].translate(FLIP)[::-1], genome[8000:]]
    (tmp_path / "draft.fa").write_text("".join(f">some{i} x\n{p}\n" for i, p in enumerate(parts)))
    reads = [genome[at : at + 2500] for at in (*range(2300, 3700, 100), *range(6300, 7700, 100))]
    reads = [r if rng.random() < 0.5 else r.translate(FLIP)[::-1] for r in reads] + ["ACGT" * 40]
    (tmp_path / "reads.fq").write_text("".join(f"@r{i}\n{r}\n+\n{'I' * len(r)}\n" for i, r in enumerate(reads)))
    params = ScaffoldParams(
        file=str(tmp_path / "draft.fa"), inputs=(str(tmp_path / "reads.fq"),), kmer_mode=True, k_value=20, min_reads=2, min_mult=2,
        end_length=1500, base_name=str(tmp_path / "out"),
    )
    run = Scaffolder(params)
    result = run.run_long(spark, cut=100, min_length=500, genome_size=1000)
    assert {(r.contig, r.length) for r in result.lengths.collect()} == {("1", 3900), ("2", 3900), ("3", 4000)}
    # tail of 1 to tail of 2 (which lies on its other strand), head of 2 to head of 3
    assert {(r.u, r.v, r.orientation) for r in result.edges.collect()} == {("1", "2", 3), ("2", "3", 0)}
    mult = {r.barcode: r.mult for r in result.extra["bx_mult"].collect()}
    assert mult == {str(i + 1): 26 for i in range(len(reads) - 1)}
    # placed pairs are cut from the reads, so no barcode has more of them than it was cut into
    assert all(r.n <= 13 for r in result.imap.groupBy("barcode").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect())
    total = sum(map(len, reads))
    run.write_tables(result)
    assert (tmp_path / "out_params.tsv").read_text().splitlines() == sorted(["read_p50\t2500", f"span\t{int(total // 1000 * 0.25)}"])
    assert (tmp_path / "out_bx_mult.tsv").read_text().splitlines() == [f"{b}\t26" for b in sorted(mult)]
    assert (tmp_path / "out_main.tsv").read_text().startswith("U\tV\t")


def test_runs_that_cannot_be(spark, tmp_path):
    for params in (ScaffoldParams(inputs=("a.fq",)), ScaffoldParams(file="c.fa", kmer_mode=True)):
        with pytest.raises(ValueError):
            Scaffolder(params).run_long(spark)


@pytest.mark.parametrize("kind", ["fa", "fq"])
def test_neither_reads_nor_contigs_are_saved(spark, tmp_path, kind):
    """What a run over long reads saves holds the ends of contigs and counts of files, not the text."""
    from scaffweave.operators.numbering import shared_folder

    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_folder(spark)) for f in names)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(100_000)) for _ in range(6)]
    record = (lambda i, s: f">s{i}\n{s}\n") if kind == "fa" else (lambda i, s: f"@s{i}\n{s}\n+\n{'I' * len(s)}\n")
    (tmp_path / "draft.fa").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(texts)))
    (tmp_path / f"reads.{kind}").write_text("".join(record(i, s) for i, s in enumerate(texts)))
    before = held()
    params = ScaffoldParams(file=str(tmp_path / "draft.fa"), inputs=(str(tmp_path / f"reads.{kind}"),), kmer_mode=True, k_value=20, end_length=300, base_name=str(tmp_path / "out"))
    result = Scaffolder(params).run_long(spark, cut=60)
    got = {(r.barcode, r.contig, r.is_head) for r in result.imap.collect()}
    assert got == {(str(i + 1), str(i + 1), h) for i in range(6) for h in (True, False)}
    assert dict(result.imap.dtypes)["barcode"] == dict(result.mult.dtypes)["barcode"] == "string"
    assert held() - before < 60_000
