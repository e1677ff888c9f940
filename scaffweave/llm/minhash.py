"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, partitions
from .words import SPACED, byte_values, find_words, mix, rolling, room, runs, text_buffer, word_hashes

SHINGLE = 5
#: Similarity as a fraction, if none is given: 100 * intersection >= 85 * union.
PERCENT = 85
#: Coordinates of a sketch.
T = 125
#: Classes of a bucket whose sketches are compared in one task; larger buckets are compared in pairs of such blocks.
BUCKET = 1000
#: Classes, and shingles of them together, in one block of exact verification; larger groups are verified in pairs of blocks.
CELL = 256
CELL_SHINGLES = 1 << 21
_VALUES = byte_values(71, lower=True)
_ODD = np.random.default_rng(73).integers(0, 2**63, 2 * T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(79).integers(0, 2**63, 2 * T, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct 5-word shingles as sorted 64-bit hashes; fewer words make one; no words none."""
    for lo, hi in runs(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, first = find_words(part, offsets[lo : hi + 1] - offsets[lo], SPACED)
        h = word_hashes(part, starts, ends, _VALUES)
        five = rolling(h, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(five[a : b - SHINGLE + 1])
            elif b > a:
                yield mix(rolling(h[a:b], b - a))
            else:
                yield np.zeros(0, np.uint64)


def sketch(x: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a set (Dahlgaard, Knudsen and Thorup, FOCS 2017).

    In round i < T every element draws a bin and a value; in round T + b it draws bin b. A coordinate is
    the smallest (round, value) that fell into its bin, so later rounds fill only bins that are empty, and
    after 2 T rounds every bin is full. Rounds are worked out several at a time; as soon as all bins are
    full the rest cannot change anything.
    """
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    step, i = max(1, 768 // len(x)), 0
    while i < 2 * T:
        rounds = np.arange(i, min(2 * T, i + step if i else max(1, min(step, T))))
        h = mix((x[None, :] + _ADD[rounds, None]) * _ODD[rounds, None])
        bins = ((h >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64)
        forced = rounds >= T
        bins[forced] = (rounds[forced] - T)[:, None]
        values = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel(), values.ravel())
        i = int(rounds[-1]) + 1
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_rows(percent: int) -> int:
    """Coordinates of a band: the most with which a pair at the threshold shares no band with probability below 1e-6."""
    return max((r for r in range(1, 11) if (1 - (percent / 100) ** r) ** (T // r) < 1e-6), default=1)


def agreement(percent: int) -> int:
    """Coordinates that a pair of one bucket must agree in to be verified together: 5.2 deviations below the mean."""
    p = percent / 100
    return max(0, math.floor(T * p - 5.2 * math.sqrt(T * p * (1 - p))))


def band_keys(s: np.ndarray, size: int) -> np.ndarray:
    bands = T // size
    rows = s[: bands * size].reshape(bands, size)
    h = np.arange(bands, dtype=np.uint64)
    for k in range(size):
        h = mix(h * _ODD[0] + rows[:, k])
    return h.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            size, prints, sketches, keys = [], [], [], []
            for x in shingle_sets(*text_buffer(part.column(1))):
                size.append(len(x))
                prints.append(_print(x.tobytes()))
                s = sketch(x) if len(x) else None
                sketches.append(None if s is None else (mix(s) & np.uint64(255)).astype(np.uint8).tobytes())
                keys.append(None if s is None else band_keys(s, band))
            columns = [part.column(0), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "print", "sketch", "keys"])


def link(n: int, near) -> np.ndarray:
    """The smallest index that each of n reaches; near(i, others) tells which of the others i is linked to."""
    label, left = np.full(n, -1), np.arange(n)
    while len(left):
        root, queue = left[0], [left[0]]
        left = left[1:]
        label[root] = root
        while queue and len(left):
            hit = near(queue.pop(), left)
            label[left[hit]] = root
            queue.extend(left[hit].tolist())
            left = left[~hit]
    return label


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in `by`, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        head = tuple(v[0] for v in values)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held)


def _edges(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Links between documents of one bucket whose sketches agree enough: a spanning forest, not all pairs."""
    a, b = [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return out

    for group in _groups(batches, "key", "i", "j"):
        docs = group.column("rep").to_numpy()
        if len(docs) < 2:
            continue
        codes = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(docs), T)
        label = link(len(docs), lambda i, others: (codes[others] == codes[i]).sum(1) >= agree)  # noqa: B023
        own = np.flatnonzero(label != np.arange(len(docs)))
        a.extend(docs[own].tolist())
        b.extend(docs[label[own]].tolist())
        if len(a) > 10_000:
            yield flush()
    yield flush()


def _blocks(rows: DataFrame, key: str, cells: str, node: str) -> DataFrame:
    """rows with i and j: a row for every pair of blocks that its own block is in; hashes of node deal the blocks."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(node), F.col(cells)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(cells) - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 blocks of shared elements."""
    n = len(sets)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[at]
    rows, at = rows[use], number[at[use]]
    out = np.zeros((n, n), np.float64)
    total = int(shared.sum())
    if n == 2:
        out[0, 1] = out[1, 0] = total
        return out
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    for low in range(0, total, columns):
        x, y = np.searchsorted(at, [low, low + columns])
        block = np.zeros((n, min(columns, total - low)), np.float32)
        block[rows[x:y], at[x:y] - low] = 1
        out += block @ block.T
    return out


def _print(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            sets = [x.tobytes() for x in shingle_sets(*text_buffer(part.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["print", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Exact links within a cell (between its two blocks, if they differ), as (document, smallest document that it reaches)."""
    for group in _groups(batches, "component", "c", "i", "d", "j"):
        group = group.take(pa.array(np.argsort(group.column("node").to_numpy(), kind="stable")))
        docs, side = group.column("node").to_numpy(), group.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        both = intersections(sets)
        size = np.array([len(s) for s in sets])
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        if side.any():
            linked &= side[:, None] != side[None, :]
        label = link(len(docs), lambda i, others: linked[i, others])  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(docs[label], pa.int64()), group.column("whole").combine_chunks()], names=["a", "b", "final"])


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """members (component, node, n) placed in the cells whose pairs may be linked: (component, node, c, i, d, j, side, whole).

    A group that fits one block is one cell. A larger one is cut into classes of about equal set sizes, such
    that linked sets are of the same class or of neighbouring ones, and each class into blocks by a hash; every
    pair of blocks of the same or of neighbouring classes is a cell.
    """
    measures = F.count("*").alias("members"), F.sum("n").alias("shingles")
    whole = members.groupBy("component").agg(*measures)
    whole = whole.select("component", ((F.col("members") <= CELL) & (F.col("shingles") <= CELL_SHINGLES)).alias("whole"))
    step = math.log(100 / min(percent, 99)) if percent > 0 else 0.0
    level = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9) if step else F.lit(0)
    sized = members.join(whole, "component").withColumn("level", F.when(F.col("whole"), 0).otherwise(level).cast("long"))
    parts = sized.groupBy("component", "level").agg(*measures)
    blocks = F.ceil(F.greatest(F.col("members") / CELL, F.col("shingles") / CELL_SHINGLES, F.lit(1.0)))
    parts = parts.select("component", "level", blocks.cast("long").alias("cells"))
    above = parts.select("component", (F.col("level") - 1).alias("level"), F.col("cells").alias("cells_above"))
    below = parts.select("component", (F.col("level") + 1).alias("level"), F.col("cells").alias("cells_below"))
    dealt = sized.join(parts.join(above, ["component", "level"], "left").join(below, ["component", "level"], "left"), ["component", "level"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cells")))

    def numbers(c):
        return F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<long>"))

    def cell(c, i, d, j, side):
        return F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), side.cast("int").alias("side"))

    c, b = F.col("level"), F.col("block")
    same = F.transform(numbers("cells"), lambda k: cell(c, F.least(b, k), c, F.greatest(b, k), b > k))
    up = F.transform(numbers("cells_above"), lambda k: cell(c, b, c + 1, k, F.lit(0)))
    down = F.transform(numbers("cells_below"), lambda k: cell(c - 1, k, c, b, F.lit(1)))
    return dealt.select("component", "node", "whole", F.explode(F.concat(same, up, down)).alias("cell")).select("component", "node", "whole", "cell.*")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    Documents whose sets of 5-word shingles have a Jaccard similarity of percent / 100 or more are linked;
    component_id is the smallest key that links reach, kept tells whether it is the document's own.

    (1) Sets are sketched; equal sets become one class with its smallest key. (2) Classes that share a band
    of their sketches meet in a bucket, where those whose sketches agree in enough coordinates are joined to
    candidate groups; a bucket gives a spanning forest, so no pairs are listed. Every link lies within a
    candidate group, but for the chance above; a hot bucket is compared in pairs of blocks. (3) The sets of a
    group, 8 bytes a shingle, come together once and all their pairs are decided; a group that is too large
    for a block is cut by set size and into blocks, and each pair of blocks that can hold links is a cell of its
    own, see _cells. (4) Components of the exact links. Copies are never listed in pairs.

    Null and empty texts have no shingles and link with nothing. Repeated rows are equal sets; rows that
    repeat a key give one row each, and texts that differ under one key are judged each by itself. Very long texts are read whole. Keys are integers; a null key gives a row
    with no component. An empty table gives no rows; other columns, of whatever names, are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    band, agree = band_rows(percent), agreement(percent)
    sketched = checkpoint(docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(lambda b: _sketches(b, band), "doc long, n_shingles long, print binary, sketch binary, keys array<long>"))
    alike = sketched.filter("print is not null and doc is not null").groupBy("print")
    classes = alike.agg(F.min("doc").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    # numbers of their own, as a key that stands on several texts may be the smallest of several classes
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("keys").alias("key"))
    crowds = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = _blocks(banded.join(crowds.select("key", F.ceil(F.col("size") / BUCKET).alias("cells")), "key"), "key", "cells", "node")
    met = (
        met.select("key", "i", "j", "node").join(classes.select("node", F.col("node").alias("rep"), "sketch"), "node").drop("node")
        .repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
        .mapInArrow(lambda b: _edges(b, agree), "a long, b long")
    )
    groups = connected_components(met)
    members = checkpoint(groups.join(classes.select("node", "n", "print", "rep"), "node"))
    placed = _cells(members.select("component", "node", "n"), percent).join(members.select("node", "print"), "node")
    # the texts of one key of each class in a group are read again, and one set of each class goes to its cells
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter("text is not null")
    texts = texts.join(members.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
    sets = texts.mapInArrow(_sets, "print binary, shingles binary").filter("print is not null").groupBy("print").agg(F.first("shingles").alias("shingles"))
    checked = (
        sets.join(placed, "print").select("component", "c", "i", "d", "j", "node", "side", "whole", "shingles")
        .repartition(n, "component", "c", "i", "d", "j").sortWithinPartitions("component", "c", "i", "d", "j", "node")
        .mapInArrow(lambda b: _verify(b, percent), "a long, b long, final boolean")
    )
    checked = checkpoint(checked)
    done = checked.filter("final").groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    wide = connected_components(checked.filter("not final").select("a", "b"))
    linked = members.select("node", "print", "rep").join(done.unionByName(wide), "node").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = classes.select("print", "rep").join(linked.join(least, "component").select("print", "component_id"), "print", "left")
    return (
        sketched.select("doc", "n_shingles", "print").join(found, "print", "left")
        .withColumn("component_id", F.coalesce("component_id", "rep", "doc"))
        .select(F.col("doc").alias(key), "n_shingles", "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))
    )
