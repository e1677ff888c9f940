"""The split reader of records against a reader that goes through the text letter by letter."""

import random

import numpy as np
import pytest

from scaffweave.sources import records as rc
from scaffweave.sources import sequences as sq


def plain_reader(text):
    """(name, comment, seq, qual) as a stream reader finds them."""
    lines, out, i = text.split("\n"), [], 0
    if lines[-1] == "":
        lines.pop()
    while i < len(lines):
        at = min((lines[i].find(c) for c in "@>" if c in lines[i]), default=-1)
        if at < 0:
            i += 1
            continue
        while True:  # records that follow without a quality
            head, seq, qual = lines[i][at + 1 :], "", None
            i += 1
            while i < len(lines) and lines[i][:1] not in ("@", ">", "+"):
                seq += lines[i]
                i += 1
            if i < len(lines) and lines[i][0] == "+":
                qual = ""
                i += 1
                while i < len(lines):
                    qual += lines[i]
                    i += 1
                    if len(qual) >= len(seq):
                        break
            name = head.split(None, 1)
            out.append(((name + [""])[0] if name and not head[:1].isspace() else "", name[1] if len(name) > 1 else "", seq, qual))
            if qual is not None or i >= len(lines):
                break
            at = 0
    return out


def fold(text, width):
    return "\n".join(text[k : k + width] for k in range(0, len(text), width))


def some_text(seed, wrap=None):
    """Records of several lines, with qualities that look like headers, FASTA between FASTQ, and blank lines."""
    rng = random.Random(seed)
    out = [rng.choice(["", "no header\n", "\n"])]
    for i in range(rng.randrange(1, 40)):
        n = rng.choice([0, 1, 3, 10, 40, 90])
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        fastq = rng.random() < 0.7
        out.append(f"{'@' if fastq else rng.choice('>@')}r{i}{rng.choice(['', ' c d', chr(9) + 'x'])}\n")
        body = fold(seq, wrap or rng.choice([1, 4, 7, 1000]))
        out.append(body + "\n" * rng.choice([1, 1, 2]) if body else rng.choice(["", "\n"]))
        if fastq:
            qual = fold("".join(rng.choice("@>+IJ#") for _ in range(n)), wrap or rng.choice([1, 4, 7, 1000]))
            out.append(f"+{rng.choice(['', 'r@x'])}\n{qual}\n")
    return "".join(out)


def numbers(lines):
    return rc.Lines(np.array([ord(x[0]) if x else 0 for x in lines], np.int64), np.array(["@" in x or ">" in x for x in lines], bool), np.array([len(x) for x in lines], np.int64))


@pytest.mark.parametrize("seed", range(60))
def test_summaries_compose_to_the_state_of_the_whole(seed):
    """From any state, two summaries applied one after another are that of the joined splits; and that is the walk's."""
    rng = random.Random(seed)
    lines = some_text(seed).split("\n")[:-1]
    cut = sorted(rng.randrange(len(lines) + 1) for _ in range(3))
    parts = [lines[a:b] for a, b in zip([0, *cut], [*cut, len(lines)], strict=True)]
    states = [(rc.SEEK, 0), *((k, v) for k in (rc.SEQ, rc.QUAL) for v in (0, 1, 2, 3, 7, 40, 500))]
    for state in states:
        now = state
        for p in parts:
            now = rc.apply(rc.summary(numbers(p)), *now)
        assert now == rc.apply(rc.summary(numbers(lines)), *state), state
        by_line = state
        for x in lines:
            by_line = rc.apply(rc.summary(numbers([x])), *by_line)
        assert by_line == now


@pytest.mark.parametrize("size", [41, 333, 1 << 20])
def test_any_split_size_gives_the_same_records(spark, tmp_path, size):
    texts = {f"f{seed}.fq": some_text(seed + 100) for seed in range(3)} | {"wide.fq": some_text(7, 60), "none.fq": "", "odd.fq": "nothing\nhere\n", "end.fq": "@a b\nAC\nGT\n+\n@@\n>>"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = rc.read_line_records(spark, [str(tmp_path / n) for n in texts]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        own = sorted((r for r in got if r.file.endswith("/" + name)), key=lambda r: r.ord)
        assert [r.ord for r in own] == list(range(len(own)))
        assert [(r.name, r.comment, r.seq, r.qual) for r in own] == plain_reader(text), name


@pytest.mark.parametrize("text", ["@a\nACGT\n+\nIII\n", "@a\nACGT\n+\nIIIII\n@b\nA\n+\nI\n", "@a\nACGT\n+\n"])
def test_a_quality_of_another_length_raises(spark, tmp_path, text):
    (tmp_path / "x.fq").write_text(text)
    with pytest.raises(Exception, match="not as long as its sequence"):
        rc.read_line_records(spark, [str(tmp_path / "x.fq")]).collect()


def test_reads_of_several_lines_pass_the_usual_reader(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a/1 BX:Z:A-1\nAC\nGT\n+\nII\n@I\n@a/2 BX:Z:A-1\nGGG\n+\n+>@\n")
    got = sorted(tuple(r) for r in sq.read_sequences(spark, str(tmp_path / "x.fastq")).drop("file").collect())
    assert got == [(0, "a/1", "BX:Z:A-1", "ACGT", "II@I"), (1, "a/2", "BX:Z:A-1", "GGG", "+>@")]


@pytest.mark.parametrize("lines", [1, 2, 3, 11])
def test_a_split_is_read_in_portions(monkeypatch, lines):
    """One split, in portions of few lines: the tables of portions lead to the state after it, and pieces of records, put
    together by portion, are those of the whole text."""
    import pyarrow as pa

    for seed in range(25):
        text = some_text(seed).split("\n")[:-1]
        columns = [[0] * len(text), [0] * len(text), [ord(x[0]) if x else 0 for x in text], ["@" in x or ">" in x for x in text], [len(x) for x in text]]
        rows = pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array([0] * len(text)) for _ in range(3)), pa.array(text)], names=["fid", "block", "first", "marked", "size", "kind", "value", "start", "line"])
        batches = [rows.slice(i, 2) for i in range(0, len(text), 2)]
        monkeypatch.setattr(rc, "PORTION_LINES", lines)
        state = rc.SEEK, 0
        for batch, (_, own_lines, _, entered, own) in zip(rc._summarise(iter(batches)), rc._entered(iter(batches)), strict=True):
            assert entered == state
            state = rc.apply(batch.to_pylist()[0], *state)
            assert own_lines.left(*entered, own) == state and own_lines.n <= lines + 1
        assert state == rc.apply(rc.summary(numbers(text)), rc.SEEK, 0)
        records = {}
        for r in [r for batch in rc._cut(iter(batches)) for r in batch.to_pylist()]:
            head, seq, qual = records.get(r["ord"], (None, "", None))
            records[r["ord"]] = head or r["head"], seq + r["seq"], qual if r["qual"] is None else (qual or "") + r["qual"]
        want = plain_reader("\n".join(text) + "\n")
        assert [records[i][1:] for i in range(len(records))] == [w[2:] for w in want]
        assert sum(b.to_pylist()[0]["n"] for b in rc._count(iter(batches))) == len(want)


@pytest.mark.parametrize("size", [41, 333, 1 << 20])
@pytest.mark.parametrize("kinds", [("fa",), ("fq",), ("fa", "fq")])
def test_records_are_numbered_where_they_lie(spark, tmp_path, size, kinds):
    """Over all files by their names, as a sort of them gives it; records of spaces alone are not counted, wherever splits lie."""
    rng = random.Random(size)
    paths = []
    for i, kind in enumerate(kinds * 3):
        path = tmp_path / f"{rng.randrange(100):02d}-{i}.{kind}"
        fasta = "".join(rng.choice([f">a{j} x\nAC\nG{'T' * j}\n", f">b{j}\nACG\n", ">\n" * rng.randrange(70), ">  \n\n"]) for j in range(rng.randrange(40)))
        path.write_text(some_text(size + i) if kind == "fq" else fasta if i else "")
        paths.append(str(path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [r.asDict() for r in sq.read_sequences(spark, *paths, number="place").collect()]
        plain = [r.asDict() for r in sq.read_sequences(spark, *paths).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain.sort(key=lambda r: (r["file"], r["ord"]))
    assert sorted(got, key=lambda r: r["place"]) == [r | {"place": i} for i, r in enumerate(plain, 1)] and plain
