"""Periodic runs of words: a suffix automaton whose link tree is walked by link-cut access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_fields
from .words import SPACED, byte_values, find_words, mix, rolling, room, runs, text_buffer, word_hashes

#: Words that a run has at least.
LEAST = 12
_VALUES = byte_values(1109)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's links and lengths by state (1 is the root, 0 is none), and the state of each prefix."""
    step, link, size, prefix = [{}, {}], [0, 0], [0, 0], []
    last = 1
    for c in words:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        prefix.append(new)
        last = new
    return link, size, prefix


def word_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list: maximal stretches with their smallest period q and a length of
    at least max(least, 2 q), by start and period.

    Word by word, the path from the prefix's state to the root is recoloured with the word's place. The path falls
    into segments of one colour, the place e where their states ended last. A segment's deepest state has the length
    of what the prefixes of i and e end with alike; where it reaches i - e, a square of period i - e ends at i. The
    segments are the preferred paths of a link-cut tree: each is a splay tree by depth, whose root holds the colour.
    """
    parent, size, prefix = automaton(words)
    n = len(parent)
    left, right, colour = [0] * n, [0] * n, [-1] * n

    def splay(x: int) -> None:
        while True:
            y = parent[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = parent[y]
            double = z and (left[z] == y or right[z] == y)
            colour[x] = colour[z] if double else colour[y]
            for v in ((y, x) if (left[z] == y) == (left[y] == x) else (x, x)) if double else (x,):
                u = parent[v]
                above = parent[u]
                if left[u] == v:
                    inner = left[u] = right[v]
                    right[v] = u
                else:
                    inner = right[u] = left[v]
                    left[v] = u
                if inner:
                    parent[inner] = u
                parent[u], parent[v] = v, above
                if above:
                    if left[above] == u:
                        left[above] = v
                    elif right[above] == u:
                        right[above] = v

    ends: dict[tuple[int, int], int] = {}
    for i, v in enumerate(prefix):
        x, below = v, 0
        while x:
            splay(x)
            if x != v and (e := colour[x]) >= 0:
                period, alike = i - e, size[x]
                if alike >= period and alike + period >= least:
                    ends[i - period - alike + 1, period] = i
            if right[x]:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, parent[x]
        splay(v)
        colour[v] = i
    return sorted((s, t - s + 1, p) for (s, p), t in ends.items())


def _repeated(h: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Words covered by a run of `width` words that stands twice in its row."""
    n = len(h)
    if n < width:
        return np.zeros(n, bool)
    window = mix(rolling(h, width) ^ (row[: n - width + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return np.cumsum(cover[:-1]) > 0


def _stretches(h: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run has words.

    A run of period q repeats all but q of its words q further on, half of `least` of them at least, and these
    repeats cover it. So words that no such repeat covers split their text, and then the parts are looked at alike.
    """
    width = -(-least // 2)
    place = np.arange(len(h))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    while len(place):
        covered = _repeated(h[place], row, width)
        kept = np.flatnonzero(covered)
        if not len(kept):
            return []
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least
        kept, part = kept[long], part[long]
        done = len(kept) == len(place)
        place, row = place[kept], part
        if done:
            break
    if not len(place):
        return []
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    tails = np.append(heads[1:], len(place)) - 1
    return list(zip(place[heads].tolist(), (place[tails] + 1).tolist(), strict=True))


def _joined(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The words of each row that are not gone, joined by one space."""
    kept = np.flatnonzero(~gone)
    use = np.zeros(len(raw) + 1, np.int8)
    use[starts[kept]] = 1
    use[ends[kept]] -= 1
    use = np.cumsum(use[:-1], dtype=np.int8).astype(bool)
    row = np.searchsorted(first, kept, side="right") - 1
    gaps = ends[kept[:-1][row[1:] == row[:-1]]]
    out = raw.copy()
    out[gaps] = 0x20
    use[gaps] = True
    bounds = np.concatenate([[0], np.cumsum(use)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[use])).cast(pa.string())


def _judge(column, least: int) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """For ranges of rows, their columns n_words, runs and collapsed."""
    raw, offsets = text_buffer(column)
    for low, high in runs(offsets):
        text, bounds = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = find_words(text, bounds, SPACED)
        h = word_hashes(text, starts, ends, _VALUES)
        found: list[list[dict]] = [[] for _ in range(high - low)]
        gone = np.zeros(len(h), bool)
        for a, b in _stretches(h, first, least):
            row = int(np.searchsorted(first, a, side="right")) - 1
            for start, length, period in word_runs(h[a:b].tolist(), least):
                if length >= max(least, 2 * period):
                    found[row].append({"start": a - int(first[row]) + start, "length": length, "period": period})
                    gone[a + start + period : a + start + length] = True
        yield low, high, [pa.array(np.diff(first), pa.int64()), pa.array(found, _RUNS), _joined(text, bounds, starts, ends, first, gone)]


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """docs (its columns `keep`, all but the text if not given) with n_words, runs and collapsed.

    Words stand between ASCII white space. `runs` lists (start, length, period) of all runs by start and period:
    stretches of consecutive words with smallest period q that no neighbouring word extends, of max(least, 2 q) words
    or more. `collapsed` joins by single spaces the words that are in no run, or in the first q of every run that
    holds them. Words are compared by 64-bit hashes. Only stretches that could hold a run go through the automaton.

    Rows are judged each for itself where they lie, nothing is shuffled; memory grows with the longest text. A null
    or empty text, or one of white space, has no words, no runs and an empty collapsed text. Keys are not looked at,
    so null and repeated ones and repeated rows are fine; columns named like the results are replaced. An empty
    table gives no rows.
    """
    new = ("n_words", "runs", "collapsed")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, columns in _judge(batch.column(0), least):
                own = [c.slice(low, high - low) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*kept, *new])

    rows = docs.select(docs[text].alias("__text"), *kept)
    shape = with_fields(docs.select(*kept), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return rows.mapInArrow(judge, shape)
