"""Records of several lines each (FASTA, FASTQ) from split files: every split is read where it lies.

Whether a line that begins with @ is a header or a quality hangs on all lines before it, so a split alone cannot tell
its records. The reader is an automaton over lines with three kinds of states:

* SEEK: the next line that holds @ or > begins a record after that letter;
* SEQ(n): in a sequence with n letters so far; a line that begins with + goes on to the quality, one that begins with
  @ or > begins the next record, any other adds its letters;
* QUAL(n): in a quality, n letters of which are missing; lines are taken until none is, at least one; then SEEK.

(1) Each split tells what it makes of every state that it could be entered in, as a small table: SEEK leads to one state;
SEQ(n) leads to one state, or by its first + to QUAL(n + x); QUAL(n) ends at a line that n decides, and nearly all of
these lead to the same few states, so the function of n is a short list of steps. (2) The tables of a file are applied
one after another, which tells the state that each split is entered in. (3) Splits count their records, and the
counts before a split are where its numbers begin. (4) Splits cut out their records; only those that lie
across splits are put together by a shuffle.

A task looks at no more than a portion of a split's lines at once. What holds for splits holds for any stretch of lines, so
in (1) every portion has a table of its own, and (3) and (4) carry the state from one portion to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import saved

SEEK, SEQ, QUAL = 0, 1, 2
_AT, _MORE, _PLUS = 64, 62, 43
#: Lines and letters of one portion (a batch that Spark hands over more at most).
PORTION_LINES, PORTION_LETTERS = 1 << 17, 1 << 23
_STEP = "array<struct<upto: long, kind: int, value: long>>"
_SUMMARY = f"fid long, block long, portion long, total long, seek struct<kind: int, value: long>, seq_by int, seq struct<kind: int, value: long>, steps {_STEP}, plus_total long, plus_steps {_STEP}"


class Lines:
    """The lines of one split as numbers: first letter (0 if empty), whether @ or > is in it, and size."""

    def __init__(self, first: np.ndarray, marked: np.ndarray, size: np.ndarray):
        self.n, self.first = len(first), first
        self.letters = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.heads = np.flatnonzero(marked)
        self.breaks = np.flatnonzero((first == _AT) | (first == _MORE) | (first == _PLUS))
        # of a record that begins at each head: the line that ends its sequence, and the one after its last
        at = np.searchsorted(self.breaks, self.heads, side="right")
        self.seq_end = np.append(self.breaks, self.n)[at]
        self.has_qual = np.append(first, 0)[self.seq_end] == _PLUS
        target = self.letters[np.minimum(self.seq_end + 1, self.n)] + self.letters[self.seq_end] - self.letters[self.heads + 1]
        qual_end = np.maximum(self.seq_end + 2, np.searchsorted(self.letters, target))
        self.end = np.where(self.has_qual, qual_end, self.seq_end)
        self.follower = np.searchsorted(self.heads, self.end)
        # the state at the end of the split, for a record that is open there
        self.open_kind = np.where(self.has_qual & (self.end > self.n), QUAL, np.where(~self.has_qual & (self.seq_end == self.n), SEQ, SEEK))
        self.open_value = np.where(self.open_kind == QUAL, target - self.letters[-1], np.where(self.open_kind == SEQ, self.letters[-1] - self.letters[np.minimum(self.heads + 1, self.n)], 0))

    def head_from(self, line: int) -> int:
        """The place in `heads` of the first record that is found from a line on."""
        return int(np.searchsorted(self.heads, line))

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """The state at the end of the split for the records that begin at each head (and, last, for none)."""
        kind, value = self.open_kind.tolist(), self.open_value.tolist()
        follower = self.follower.tolist()
        kind.append(SEEK)
        value.append(0)
        for i in range(len(follower) - 1, -1, -1):
            if kind[i] == SEEK:
                j = follower[i]
                kind[i], value[i] = kind[j], value[j]
        return np.array(kind, np.int64), np.array(value, np.int64)

    def qual_end(self, line: int, missing: int) -> int:
        """The line after a quality that goes on at `line`; beyond the last if it is still open there."""
        return max(line + 1, int(np.searchsorted(self.letters, self.letters[line] + missing)))

    def entered(self, kind: int, value: int) -> tuple[int, int, int]:
        """For the state that the split is entered in: the lines of sequence and the line after the quality that belong
        to the record before (n + 1 if that is open at the end), and the head of the first record that begins here."""
        if kind == SEEK:
            return 0, 0, self.head_from(0)
        if kind == QUAL:
            end = self.qual_end(0, value)
            return 0, end, self.head_from(end)
        stop = int(self.breaks[0]) if len(self.breaks) else self.n
        if stop < self.n and self.first[stop] == _PLUS:
            end = self.qual_end(stop + 1, value + int(self.letters[stop]))
            return stop, end, self.head_from(end)
        return stop, stop, self.head_from(stop)

    def left(self, kind: int, value: int, own: np.ndarray) -> tuple[int, int]:
        """The state after the last line, from the one that the lines are entered in and the records that begin here."""
        if len(own):
            return int(self.open_kind[own[-1]]), int(self.open_value[own[-1]])
        if kind == SEEK:
            return SEEK, 0
        line = 0
        if kind == SEQ:
            line = int(self.breaks[0]) if len(self.breaks) else self.n
            if line == self.n:
                return SEQ, value + int(self.letters[-1])
            value += int(self.letters[line])
            line += 1  # it begins with +, else a record would begin here
        if self.qual_end(line, value) > self.n:
            return QUAL, value - int(self.letters[-1] - self.letters[line])
        return SEEK, 0

    def chain(self, head: int) -> np.ndarray:
        """The records from a head on, as places in `heads`."""
        out, follower, n = [], self.follower.tolist(), len(self.heads)
        while head < n:
            out.append(head)
            head = follower[head]
        return np.array(out, np.int64)


def summary(lines: Lines) -> dict:
    """What a split makes of the states it can be entered in."""
    kind, value = lines.exits()
    state = lambda line: {"kind": int(kind[i := lines.head_from(line)]), "value": int(value[i])}

    def steps(line: int) -> list[dict]:
        ends = np.arange(line + 1, lines.n + 1)
        at = np.searchsorted(lines.heads, ends)
        k, v = kind[at], value[at]
        last = np.flatnonzero(np.append((k[1:] != k[:-1]) | (v[1:] != v[:-1]), True)) if len(ends) else []
        return [{"upto": int(lines.letters[ends[i]] - lines.letters[line]), "kind": int(k[i]), "value": int(v[i])} for i in last]

    stop = int(lines.breaks[0]) if len(lines.breaks) else lines.n
    out = {"total": int(lines.letters[-1]), "seek": state(0), "steps": steps(0), "plus_total": 0, "plus_steps": []}
    if stop == lines.n:
        return out | {"seq_by": SEQ, "seq": {"kind": SEQ, "value": int(lines.letters[-1])}}
    if lines.first[stop] != _PLUS:
        return out | {"seq_by": SEEK, "seq": state(stop)}
    rest = int(lines.letters[-1] - lines.letters[stop + 1])
    return out | {"seq_by": QUAL, "seq": {"kind": QUAL, "value": int(lines.letters[stop])}, "plus_total": rest, "plus_steps": steps(stop + 1)}


def _after_quality(missing: int, total: int, steps: list) -> tuple[int, int]:
    for s in steps:
        if missing <= s["upto"]:
            return s["kind"], s["value"]
    return QUAL, missing - total


def apply(split: dict, kind: int, value: int) -> tuple[int, int]:
    """The state after a split with this summary that is entered in (kind, value)."""
    if kind == SEEK:
        return split["seek"]["kind"], split["seek"]["value"]
    if kind == QUAL:
        return _after_quality(value, split["total"], split["steps"])
    if split["seq_by"] == SEQ:
        return SEQ, value + split["seq"]["value"]
    if split["seq_by"] == SEEK:
        return split["seq"]["kind"], split["seq"]["value"]
    return _after_quality(value + split["seq"]["value"], split["plus_total"], split["plus_steps"])


def _enter(splits: pd.DataFrame) -> pd.DataFrame:
    """The state that each split of a file is entered in, from the tables of its portions."""
    kind, value, out = SEEK, 0, []
    for split in splits.sort_values(["block", "portion"]).to_dict("records"):
        if split["portion"] == 0:
            out.append((split["fid"], split["block"], kind, value))
        kind, value = apply(split, kind, value)
    return pd.DataFrame(out, columns=["fid", "block", "kind", "value"])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each split in portions, numbered from 0; batches hold the splits of a task one after another, with all
    lines in order, and their columns begin with fid, block, first, marked, size."""
    held: list[pa.RecordBatch] = []
    split, number, lines, letters = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        fid, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((fid[1:] != fid[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if (fid[low], block[low]) != split:
                if held:
                    yield number, pa.Table.from_batches(held)
                held, split, number, lines, letters = [], (fid[low], block[low]), 0, 0, 0
            held.append(batch.slice(low, high - low))
            lines, letters = lines + high - low, letters + pc.sum(held[-1].column(4)).as_py()
            if lines >= PORTION_LINES or letters >= PORTION_LETTERS:
                yield number, pa.Table.from_batches(held)
                held, number, lines, letters = [], number + 1, 0, 0
    if held:
        yield number, pa.Table.from_batches(held)


def _numbers(table: pa.Table) -> Lines:
    return Lines(*(table.column(c).to_numpy() for c in ("first", "marked", "size")))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, table in _portions(batches):
        row = {"fid": table.column("fid")[0].as_py(), "block": table.column("block")[0].as_py(), "portion": number} | summary(_numbers(table))
        yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY_TYPE)


_STATE = pa.struct([("kind", pa.int32()), ("value", pa.int64())])
_STEPS = pa.list_(pa.struct([("upto", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))
_SUMMARY_TYPE = pa.schema(
    [("fid", pa.int64()), ("block", pa.int64()), ("portion", pa.int64()), ("total", pa.int64()), ("seek", _STATE), ("seq_by", pa.int32()), ("seq", _STATE), ("steps", _STEPS), ("plus_total", pa.int64()), ("plus_steps", _STEPS)]
)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Lines, int, tuple[int, int], np.ndarray]]:
    """Portions with their lines, number, the state that they are entered in and the records that begin in them."""
    for number, table in _portions(batches):
        lines = _numbers(table)
        if number == 0:
            state = table.column("kind")[0].as_py(), table.column("value")[0].as_py()
        own = lines.chain(lines.entered(*state)[2])
        yield table, lines, number, state, own
        state = lines.left(*state, own)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, lines, _, _, own in _entered(batches):
        yield pa.RecordBatch.from_pylist([{"fid": table.column("fid")[0].as_py(), "block": table.column("block")[0].as_py(), "n": len(own)}])


def _gathered(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """For each range of lines their text without the line ends; ranges ascend and don't overlap."""
    low, high = offsets[begin], offsets[np.maximum(begin, end)]
    some = high > low  # what is empty may lie anywhere
    turns = np.diff(np.concatenate([[0], np.stack([low[some], high[some]], 1).ravel(), [len(data)]]))
    use = np.repeat(np.arange(len(turns)) % 2 == 1, turns)
    bounds = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(data[use])).cast(pa.string())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin in a portion of a split, and first what of one begun before lies in it (with a null head)."""
    for table, lines, number, (kind, value), own in _entered(batches):
        fid, block = (table.column(c)[0].as_py() for c in ("fid", "block"))
        start = table.column("start")[0].as_py() if number == 0 else start + begun
        begun = len(own)
        text = pa.concat_arrays(table.column("line").chunks).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + lines.n + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        seq_lines, done, _ = lines.entered(kind, value)
        heads, seq_end, end = lines.heads[own], lines.seq_end[own], np.minimum(lines.end[own], lines.n)
        has_qual, is_open = lines.has_qual[own], lines.open_kind[own] != SEEK
        names = text.take(pa.array(heads)).cast(pa.string())
        ords = start + np.arange(len(own))
        seq_begin, qual_begin = heads + 1, np.minimum(seq_end + 1, lines.n)
        if kind != SEEK:  # the piece of the record before
            plus = kind == QUAL or seq_lines < done
            begin = 0 if kind == QUAL else min(seq_lines + 1, lines.n)
            names = pa.concat_arrays([pa.array([None], pa.string()), names])
            ords, has_qual, is_open = np.append(start - 1, ords), np.append(plus, has_qual), np.append(True, is_open)
            seq_begin, seq_end = np.append(0, seq_begin), np.append(seq_lines, seq_end)
            qual_begin, end = np.append(begin, qual_begin), np.append(min(done, lines.n) if plus else begin, end)
        qual = _gathered(data, offsets, qual_begin, np.where(has_qual, end, qual_begin))
        qual = pc.if_else(pa.array(has_qual), qual, pa.scalar(None, pa.string()))
        columns = [pa.array(np.full(len(ords), fid)), pa.array(np.full(len(ords), block)), pa.array(np.full(len(ords), number)), pa.array(ords), pa.array(is_open), names, _gathered(data, offsets, seq_begin, seq_end), qual]
        for low in range(0, len(ords), 1 << 14):
            yield pa.RecordBatch.from_arrays([c.slice(low, 1 << 14) for c in columns], names=["fid", "block", "portion", "ord", "open", "head", "seq", "qual"])


def read_line_records(spark: SparkSession, paths: list[str], number: str | None = None) -> DataFrame:
    """(file, ord, name, comment, seq, qual) of the records of FASTA and FASTQ files, numbered from 0 in each file.

    Sequences and qualities may take any number of lines; qual is null where a record has no + line. A quality
    that is not as long as its sequence raises. Files are split as Spark splits text (compressed ones are not). A text of no
    records gives no rows. With number also this column: the place of a record in all files, in the order of their names, from 1.
    """
    lines = spark.read.text(paths).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("fid"), F.col("_metadata.file_block_start").alias("block"), F.ascii("value").alias("first"),
        (F.instr("value", "@") + F.instr("value", ">") > 0).alias("marked"), F.length("value").alias("size"), F.col("value").alias("line"),
    )
    numbers = ["fid", "block", "first", "marked", "size"]
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file")).withColumn("fid", F.xxhash64("file"))
    entered = saved(lines.select(*numbers).mapInArrow(_summarise, _SUMMARY).groupBy("fid").applyInPandas(_enter, "fid long, block long, kind int, value long"))
    known = lambda frame, splits: frame.join(F.broadcast(splits), ["fid", "block"])  # noqa: E731  one small row a split
    counts = known(lines.select(*numbers), entered).mapInArrow(_count, "fid long, block long, n long").groupBy("fid", "block").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = saved(entered.join(counts, ["fid", "block"]).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    if number:  # every record of a file has its place in it, so the counts of the files before are all that is missing
        by_file = begins.groupBy("fid").agg(F.sum("n").alias("n")).join(files, "fid")
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = by_file.select("fid", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cut = known(lines, begins.drop("n")).select(*numbers, "kind", "value", "start", "line").mapInArrow(_cut, "fid long, block long, portion long, ord long, open boolean, head string, seq string, qual string")
    place = [(F.col("ord") + F.col("before") + 1).alias(number)] if number else []
    return _whole(cut).join(F.broadcast(files), "fid").select("file", "ord", *_head(), "seq", "qual", *place)


def _whole(cut: DataFrame) -> DataFrame:
    """Records, with those in pieces put together; the lengths of sequence and quality are compared."""
    pieces = cut.filter("open").groupBy("fid", "ord").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("block", "portion", "seq", "qual"))).alias("parts"), F.max(F.col("qual").isNotNull()).alias("has"))
    joined: Callable = lambda name: F.array_join(F.transform("parts", lambda p: F.coalesce(p[name], F.lit(""))), "")
    together = pieces.select("fid", "ord", "head", joined("seq").alias("seq"), F.when(F.col("has"), joined("qual")).alias("qual"))
    rows = cut.filter("not open").select("fid", "ord", "head", "seq", "qual").unionByName(together)
    message = F.concat(F.lit("the quality of "), F.col("head"), F.lit(" is not as long as its sequence"))
    wrong = F.col("qual").isNotNull() & (F.length("qual") != F.length("seq"))
    return rows.withColumn("qual", F.when(wrong, F.raise_error(message)).otherwise(F.col("qual")))


def _head() -> list:
    text = F.regexp_extract("head", r"^[^@>]*[@>](.*)$", 1)
    return [F.regexp_extract(text, r"^(\S*)", 1).alias("name"), F.regexp_extract(text, r"^\S*\s+(.*)$", 1).alias("comment")]
