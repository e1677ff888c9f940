"""Spelling variants of words: squared distances of letter counts from blocked Gram matrices, then verified edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions

#: Words are runs of these letters.
LETTERS = "[A-Za-zÀ-ÿ]+"
_BLOCK = ["short", "tail", "affix", "i", "j"]
#: Words of a block that one task compares at once; larger blocks are compared in pairs of parts.
CELL = 4096
#: Rows of one Gram matrix, and columns of its letter counts; letters that share a column only add candidates.
TILE = 512
COLUMNS = 64
#: A form is at least so many times as frequent as its word.
RATIO = 5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep..., word) for every run of letters in a text, A-Z lower-cased and nothing else."""
    words = docs.select(*(keep or []), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS})"))).alias("word"))
    lower = F.when(F.col("word").rlike("[A-Z]"), F.translate("word", _CAPITALS, _CAPITALS.lower())).otherwise(F.col("word"))
    return words.withColumn("word", lower)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a row each, ended by zeros; and their numbers."""
    size = np.array([len(w) for w in words], np.int64)
    grid = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint32)
    grid[np.arange(grid.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return grid, size


def one_edit(grid: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows, size[b] equal to size[a] or one more: whether one edit parts them, and their common prefix."""
    x, y = grid[a], grid[b]
    differ = x != y
    prefix = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    at = np.arange(x.shape[1])
    after = (at > prefix[:, None]) & (at <= np.maximum(size[a], size[b])[:, None])
    same = (size[a] == size[b]) & ~(differ & after).any(1) & (prefix < size[a])
    shifted = np.zeros_like(differ)
    shifted[:, 1:] = x[:, :-1] != y[:, 1:]
    return same | ((size[b] == size[a] + 1) & ~(shifted & after).any(1)), prefix


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells, several small ones at once."""
    from .minhash import _groups

    held: list[pa.Table] = []
    for cell in _groups(batches, *_BLOCK):
        if held and sum(t.num_rows for t in held) + cell.num_rows > TILE:
            yield pa.concat_tables(held)
            held = []
        held.append(cell)
    if held:
        yield pa.concat_tables(held)


def _near_pairs(tile: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a tile and its pairs that one edit parts, each pair of a block in one of its cells only."""
    words = tile.column("word").to_pylist()
    grid, size = _points(words)
    counts = np.zeros((len(words), COLUMNS), np.float32)
    row, column = np.nonzero(grid)
    np.add.at(counts, (row, grid[row, column] % COLUMNS), 1)
    norm = (counts * counts).sum(1)
    block, short, part, two = (tile.column(c).to_numpy() for c in ("block", "short", "part", "two"))
    tail = tile.column("tail").to_numpy()
    firsts, seconds = [], []
    for low in range(0, len(words), TILE):
        high = min(low + TILE, len(words))
        gram = counts[low:high] @ counts.T
        near = norm[low:high, None] + norm[None, :] - 2 * gram <= 2
        # the first of a pair has the block's shorter length; of two such the first stands before
        a, b = np.nonzero(near & (block[low:high, None] == block[None, :]) & (size[low:high] == short[low:high])[:, None])
        a += low
        use = (size[b] > size[a]) | (a < b)
        use &= ~two[a] | (part[a] != part[b])
        firsts.append(a[use])
        seconds.append(b[use])
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    true, prefix = one_edit(grid, size, a, b)
    true &= ~tail[a] | (prefix < short[a] // 2)  # else the pair is in the block of its common prefix too
    return words, a[true], b[true]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word with near ones in a tile: their number, and the most frequent of them (of equal ones the first)."""
    for tile in _tiles(batches):
        tile = tile.append_column("block", pa.array(np.cumsum(_changes(tile))))
        tile = tile.append_column("two", pa.array(tile.column("i").to_numpy() != tile.column("j").to_numpy()))
        words, a, b = _near_pairs(tile)
        if not len(a):
            continue
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        n = tile.column("n").to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        word = pa.array(words)
        columns = [word.take(pa.array(a[head])), pa.array(np.diff(np.append(head, len(a)))), pa.array(n[b[head]]), word.take(pa.array(b[head]))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "best_n", "best"])


def _changes(tile: pa.Table) -> np.ndarray:
    out = np.zeros(tile.num_rows, bool)
    for name in _BLOCK:
        v = tile.column(name).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) of distinct (word, n): how many words one edit away there are, and the best one.

    Words of neighbouring lengths l and l + 1 are compared in blocks. One edit leaves the first or the last l // 2
    code points as they are, so a block holds words that begin alike, or end alike; a word is in four blocks. Blocks
    of more than CELL words are compared in pairs of hashed parts.
    """
    size = F.length("word")
    affixes = [
        F.struct(short.alias("short"), F.lit(tail).alias("tail"), (F.right if tail else F.left)(F.col("word"), F.floor(short / 2).cast("int")).alias("affix"))
        for short in (size, size - 1)
        for tail in (False, True)
    ]
    placed = words.filter(size > 0).select("word", "n", F.explode(F.array(*affixes)).alias("p")).select("word", "n", "p.*").filter("short > 0")
    key = ["short", "tail", "affix"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / CELL).alias("parts"), F.count("*").alias("__rows")).filter("__rows > 1").drop("__rows")
    parted = placed.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = parted.select("word", "n", *key, "part", other.alias("__other"))
    cells = cells.select("word", "n", *key, "part", F.least("part", "__other").alias("i"), F.greatest("part", "__other").alias("j"))
    cells = cells.repartition(partitions(words.sparkSession), *_BLOCK).sortWithinPartitions(*_BLOCK, "word")
    found = cells.mapInArrow(_compare, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its
    near word of largest n (of equal ones the first in code-point order), if that is at least ratio times the word's
    own; else null. Root follows forms to their end and is the word itself without one. As n grows at every step by
    `ratio`, doubling the steps ends after a few rounds.

    Null and empty words and null numbers are left out; numbers of repeated words are added up; columns other than
    word and n are ignored. Very long words are compared like others. An empty table gives no rows.
    """
    counted = words.filter("word <> '' and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    counted = checkpoint(counted)
    found = near_words(counted)
    fits = F.col("best_n") >= ratio * F.col("n")
    judged = counted.join(found, "word", "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    judged = checkpoint(judged)
    roots = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.toDF("root", "further")
        roots = checkpoint(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return judged.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
