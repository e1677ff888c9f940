"""Reads of every format through one reader, against fixtures and a plain restatement of trimming."""

import random

import pytest

from scaffweave.sources.rich import read_rich


def written(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def reads(frame):
    return [(r.name, r.comment, r.anchor, r.seq, r.qual) for r in frame.orderBy("ord").collect()]


def test_fasta(spark, tmp_path):
    path = written(tmp_path, "a.fa", "# made by hand", ">a x y", "acgT", "ACG", "# between", ">b 1:N:0:ACGT", "ggCCtt", ">rej 1:Y:0:ACGT", "AC", ">long/1 2:N:0:", "A" * 9, ">t", "T0120")
    assert reads(read_rich(spark, path)) == [("a", "x y", None, "ACGTACG", None), ("b", "1:N:0:ACGT", None, "GGCCTT", None), ("long/1", "2:N:0:", None, "A" * 9, None), ("t", "", "T", "120", None)]
    kept = reads(read_rich(spark, path, chastity=False, min_length=3, trim_masked=True, fold_case=False, max_length=4))
    assert [(n, s) for n, _, _, s, _ in kept] == [("a", "TACG"), ("b", "CC"), ("long/1", "AAAA"), ("t", "120")]
    with pytest.raises(Exception, match="empty sequence"):
        read_rich(spark, written(tmp_path, "e.fa", ">a", ">b", "AC")).collect()


def test_fastq(spark, tmp_path):
    path = written(tmp_path, "a.fq", "@HD\tVN:1.0", "@r1 1:N:0:AC", "ACGTN", "+", "!I!I!", "@r2", "T12.3", "+", "!IIII", "@CO\tsome text", "@r3 2:Y:0:AC", "ACGT", "+", "IIII", "@x 1:N:0:", "acgt", "+", "!!!!")
    found = reads(read_rich(spark, path, quality=20))
    # the name of x is too short for a number
    assert found == [("r1", "1:N:0:AC", None, "CGT", "I!I"), ("r2", "", "G", "2.3", "III"), ("x", "1:N:0:", None, "A", "!")]
    assert [x[3] for x in reads(read_rich(spark, path, chastity=False))] == ["ACGTN", "2.3", "ACGT", "ACGT"]


def sam(name, flag, seq, qual, *tags):
    return "\t".join([name, str(flag), "c", "1", "60", "5M", "=", "1", "0", seq, qual, *tags])


def test_alignments(spark, tmp_path):
    path = written(
        tmp_path, "a.sam", "@HD\tVN:1.0", "@SQ\tSN:c\tLN:50", sam("p", 0x41, "ACCGT", "ABCDE", "BX:Z:x"), sam("p", 0x91, "AACGn", "ABCDE"), sam("s", 0x100, "A", "A"),
        sam("q", 0x200, "AC", "II"), sam("u", 0x10, "AACC", "*"), sam("v", 4, "*", "*"),
    )
    want = [("p/1", "1:N:0:", None, "ACCGT", "ABCDE"), ("p/2", "2:N:0:", None, "nCGTT", "EDCBA"), ("u", "0:N:0:", None, "GGTT", None), ("v", "0:N:0:", None, "", None)]
    assert reads(read_rich(spark, path)) == want
    assert ("q", "0:Y:0:", None, "AC", "II") in reads(read_rich(spark, path, chastity=False))
    with pytest.raises(Exception, match="make no sense"):
        read_rich(spark, written(tmp_path, "b.sam", sam("p", 0xC1, "A", "A"))).collect()


def test_qseq_and_export(spark, tmp_path):
    qseq = ["M", "7", "1", "2", "3", "4", "0", "1", "AC.T", "hhBh", "1"]
    turned = ["M", "", "1", "2", "3", "4", "ACGT", "3", "ACCT", "BBhB", "0"]
    export = ["M", "7", "1", "2", "3", "4", "", "2", "ACGT", ";hh@", *["x"] * 11, "Y"]
    path = written(tmp_path, "s_1_qseq.txt", *["\t".join(x) for x in (qseq, turned, export)])
    assert reads(read_rich(spark, path)) == [("M:7:1:2:3:4/1", "1:N:0:", None, "AC.T", "hhBh"), ("M:7:1:2:3:4/2", "2:N:0:", None, "ACGT", ";hh@")]
    found = reads(read_rich(spark, path, chastity=False, quality=10, convert_quality=True))
    assert found == [("M:7:1:2:3:4/1", "1:N:0:", None, "AC.T", "II#I"), ("M:1:2:3:4#ACGT/2", "3:Y:0:", None, "C", "I"), ("M:7:1:2:3:4/2", "2:N:0:", None, "CG", "II")]
    assert reads(read_rich(spark, path, convert_quality=True))[1][4] == "!II!"
    with pytest.raises(Exception, match="chastity"):
        read_rich(spark, written(tmp_path, "b_qseq.txt", "\t".join([*qseq[:-1], "2"]))).collect()
    with pytest.raises(Exception, match="11 fields"):
        read_rich(spark, written(tmp_path, "c_qseq.txt", "a\tb")).collect()
    with pytest.raises(Exception, match="differ in length"):
        read_rich(spark, written(tmp_path, "d_qseq.txt", "\t".join([*qseq[:9], "hhB", "1"]))).collect()
    with pytest.raises(Exception, match="out of range"):
        read_rich(spark, written(tmp_path, "e_qseq.txt", "\t".join([*qseq[:9], "hh!h", "1"])), convert_quality=True).collect()


def test_all_formats_together_and_trimming(spark, tmp_path):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ACGT") for _ in range(n)), "".join(chr(33 + rng.choice([2, 2, 2, 30])) for _ in range(n))) for n in (rng.randrange(1, 12) for _ in range(200))]
    fastq = written(tmp_path, "m.fastq", *[x for i, (s, q) in enumerate(rows) for x in (f"@r{i}", s, "+", q)])
    table = written(tmp_path, "m.sam", *[sam(f"r{i}", 0, s, q) for i, (s, q) in enumerate(rows)])
    fasta = written(tmp_path, "m.fa", *[x for i, (s, _) in enumerate(rows) for x in (f">r{i}", s)])
    want = {}
    for i, (s, q) in enumerate(rows):
        good = [j for j, c in enumerate(q) if ord(c) - 33 >= 20]
        low, high = (good[0], good[-1] + 1) if good else (0, 1)
        want[f"r{i}"] = (s[low:high], q[low:high])
    got = read_rich(spark, fastq, table, fasta, quality=20).collect()
    assert len(got) == 600
    for r in got:
        assert (r.seq, r.qual) == ((rows[int(r.name[1:])][0], None) if r.file.endswith(".fa") else want[r.name])
