"""Benchmark decontamination with an FM-index for each shard of training text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, with_fields
from .words import ALNUM, byte_values, find_words, room, runs, text_buffer, word_hashes

WINDOW = 10
#: Benchmark text that one pass holds at a time; a larger benchmark is searched in as many passes as it takes.
PHRASE_BYTES = 8 << 20
#: Words of training text in one FM-index, about.
SHARD_BYTES = 4 << 20
_VALUES = byte_values(5, lower=True)


class Wavelet:
    """A wavelet matrix: ranks of any symbol, and the symbol at any place, for arrays of queries at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.zeros, self.ones = [], []
        self.levels = max(1, int(top).bit_length())
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            counts = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(len(symbols) - int(counts[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before low and before high."""
        begin = np.zeros_like(low)
        for i, level in enumerate(reversed(range(self.levels))):
            ones, zeros = self.ones[i], self.zeros[i]
            one = ((symbol >> level) & 1).astype(bool)
            place = lambda x: np.where(one, zeros + ones[x], x - ones[x])
            begin, low, high = place(begin), place(low), place(high)
        return low - begin, high - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and their ranks there."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for i in range(self.levels):
            ones, zeros = self.ones[i], self.zeros[i]
            one = (ones[at + 1] - ones[at]).astype(bool)
            symbol = symbol * 2 + one
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol, at - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling over the suffixes that are not yet told apart."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    width = 1
    while True:
        heads = np.flatnonzero(new)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        suffix = order[open_at]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)] + 1, 0)
        key = rank[suffix] * np.int64(n + 1) + after
        by = np.argsort(key, kind="stable")
        order[open_at] = suffix[by]
        key = key[by]
        new[open_at] = np.concatenate([[True], key[1:] != key[:-1]])
        width *= 2


class FMIndex:
    """Backward search over one shard: symbols from 1 up, 0 for what no phrase holds."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 8):
        text = np.append(text + 1, 0)  # one smallest symbol ends the text
        self.n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        self.wavelet = Wavelet(last, top + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 3))]).astype(np.int64)
        marked = order % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the phrases (rows, right-aligned, padded at the left)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(1, phrases.shape[1] + 1):
            live = live[(high[live] > low[live])]
            now = live[lengths[live] >= step]
            if not len(now):
                break
            symbol = phrases[now, -step] + 1
            lo, hi = self.wavelet.rank(symbol, low[now], high[now])
            low[now], high[now] = self.before[symbol] + lo, self.before[symbol] + hi
        return low, np.maximum(high, low)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence, walking back to sampled suffix positions."""
        phrase = np.repeat(np.arange(len(low)), high - low)
        row = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a] or [np.zeros(0, np.int64)])
        position, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        left = np.arange(len(row))
        while len(left):
            at = row[left]
            is_marked = self.marked[at + 1] > self.marked[at]
            done = left[is_marked]
            position[done] = self.samples[self.marked[row[done]]] + steps[done]
            left = left[~is_marked]
            symbol, rank = self.wavelet.access(row[left])
            row[left] = self.before[symbol] + rank
            steps[left] += 1
        return phrase, position


def phrases_of(items: list[tuple]) -> tuple:
    """Windows of the benchmark items, all in numpy: the vocabulary, a row of word symbols for each different window
    (right-aligned, 0 before a short one), its length, the items of window w at owners[begins[w] : begins[w + 1]], the ids
    of the items, and the length of the shortest window."""
    column = pa.array([text for _, text in items], pa.large_string())
    raw, offsets = text_buffer(column)
    starts, ends, first = find_words(raw, offsets, ALNUM)
    hashes = word_hashes(raw, starts, ends, _VALUES)
    vocabulary = np.unique(hashes)
    symbols = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    counts = np.diff(first)
    windows = np.where(counts > 0, np.maximum(1, counts - WINDOW + 1), 0)
    owner = np.repeat(np.arange(len(items), dtype=np.int32), windows)
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(counts[owner], WINDOW)
    rows = np.zeros((len(owner), WINDOW), np.int32)
    for i in range(WINDOW):  # the i-th word from the right
        held = size > i
        rows[held, WINDOW - 1 - i] = symbols[begin[held] + size[held] - 1 - i]
    rows, which = np.unique(rows, axis=0, return_inverse=True)
    owned = np.unique(which.reshape(-1).astype(np.int64) * max(1, len(items)) + owner)
    begins = np.searchsorted(owned, np.arange(len(rows) + 1) * max(1, len(items)))
    lengths = (rows > 0).sum(axis=1)
    shortest = int(lengths.min()) if len(lengths) else 0
    return vocabulary, rows, lengths, (begins, (owned % max(1, len(items))).astype(np.int32)), [str(k) for k, _ in items], shortest


def search_shard(raw: np.ndarray, offsets: np.ndarray, phrases: tuple):
    """Word places of one shard, which words are hit, and different pairs of row and item.

    Words that no phrase holds cannot be in an occurrence, so each stretch of them is one break in the
    indexed text; stretches of known words shorter than the shortest phrase are left out likewise. Phrases with a word
    that the indexed text lacks cannot occur in it and are not searched.
    """
    vocabulary, rows, lengths, (begins, owners), ids, shortest = phrases
    parts, seen = [], 0
    begin = []
    for lo, hi in runs(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, first = find_words(part, offsets[lo : hi + 1] - offsets[lo], ALNUM)
        hashes = word_hashes(part, starts, ends, _VALUES)
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
        known = np.where(vocabulary[at] == hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)
        parts.append((starts + offsets[lo], ends + offsets[lo], known))
        begin.append(first[:-1] + seen)
        seen += len(starts)
    starts, ends, symbols = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    first = np.append(np.concatenate(begin) if begin else np.zeros(0, np.int64), seen)
    n = len(symbols)
    diff = np.zeros(n + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    if n and len(rows):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (symbols[1:] == 0) | (symbols[:-1] == 0)])
        heads = np.flatnonzero(edge)
        sizes = np.diff(np.append(heads, n))
        good = np.repeat((symbols[heads] > 0) & (sizes >= shortest), sizes)
        kept = np.flatnonzero(good)
        if len(kept):
            # one break before each stretch
            breaks = edge[kept]
            target = np.arange(len(kept)) + np.cumsum(breaks)
            text = np.zeros(int(target[-1]) + 1, np.int64)
            place = np.zeros(len(text), np.int64)
            text[target], place[target] = symbols[kept], kept
            index = FMIndex(text, len(vocabulary))
            held = np.zeros(len(vocabulary) + 1, bool)
            held[0], held[text] = True, True
            asked = np.flatnonzero(held[rows].all(axis=1))
            low, high = index.search(rows[asked].astype(np.int64), lengths[asked])
            phrase, position = index.locate(low, high)
            phrase = asked[phrase]
            at = place[position]
            np.add.at(diff, at, 1)
            np.add.at(diff, at + lengths[phrase], -1)
            found = np.unique(doc[at] * np.int64(len(rows)) + phrase)
            d, p = found // len(rows), found % len(rows)
            many = begins[p + 1] - begins[p]
            item = owners[np.repeat(begins[p], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
            both = np.unique(np.repeat(d, many) * np.int64(len(ids)) + item)
            pairs = np.stack([both // len(ids), both % len(ids)], axis=1)
    hit = np.cumsum(diff[:-1]) > 0
    return starts, ends, first, hit, pairs


def shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in runs(offsets, SHARD_BYTES):
            yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def without_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its merged spans of hit words; one space stands where a span was cut out inside."""
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2):
        out.append(raw[at : starts[a]].decode())
        at = int(ends[b - 1])
    out.append(raw[at:].decode())
    return " ".join(x for x in (y.strip() for y in out) if x)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in lists of about PHRASE_BYTES, so that what is broadcast is bounded."""
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("phrase")).filter("phrase is not null and item is not null")
    size = items.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    n = max(1, -(-size // PHRASE_BYTES))
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(n)) == i)
        merged = sorted((tuple(r) for r in part.distinct().collect()), key=lambda r: (str(r[0]), r[1]))
        if merged or n == 1:
            yield merged


def find_contamination(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", benchmark_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items (array of item ids as strings), clean_text.

    A word is hit if an occurrence of a window of an item covers it; a window is 10 consecutive words, or
    a whole shorter item. Each Arrow batch of documents is cut into shards of about 4 MB; a shard's word
    symbols get an FM-index (suffix order, wavelet matrix of the transform, sampled suffix positions), all
    windows are searched backwards at once, and their occurrences merge into the spans that clean_text
    lacks. Texts stay where they are read: no shuffle. A benchmark of more than PHRASE_BYTES takes as many
    passes, each of which holds one block of it: texts are saved once, a pass gives the rows that it hits and a bit for
    each of their words, and these meet the texts at the end. Null texts and benchmark texts have no words; items
    with a null id are left out; items with no words never occur; repeated rows are judged alike; repeated item ids count as one item; an
    empty table gives no rows. Columns of docs named like these results are replaced.
    """
    new = ("n_words", "n_hit", "items", "clean_text", "__row", "__hit", "__items")
    kept = [c for c in docs.columns if c not in new]
    frame, context = docs.select(*kept), docs.sparkSession.sparkContext
    shape = with_fields(frame, "n_words long, n_hit long, items array<string>, clean_text string")
    blocks = _blocks(benchmark, item, benchmark_text)
    block = next(blocks)
    after = next(blocks, None)
    if after is None:
        return frame.mapInArrow(_search(context.broadcast(phrases_of(block)), text, kept), shape)
    numbered = checkpoint(frame.withColumn("__row", F.monotonically_increasing_id()))
    passes = []
    for own in chain([block, after], blocks):
        sent = context.broadcast(phrases_of(own))
        passes.append(checkpoint(numbered.select("__row", text).mapInArrow(_hits(sent, text), "__row long, __hit binary, __items array<string>")))
        sent.unpersist()  # the next pass holds its own block alone
    merged = reduce(DataFrame.unionByName, passes).groupBy("__row").agg(F.collect_list("__hit").alias("__hit"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    return numbered.join(merged, "__row", "left").select(*kept, "__hit", "__items").mapInArrow(_merge(text, kept), shape)


def _hits(sent: Broadcast, text: str):
    """One of several passes: (__row, __hit, __items) of the rows that it hits, a bit for each word."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shards(batches, text):
            _, _, first, hit, pairs = search_shard(raw, offsets, sent.value)
            rows, at = np.unique(pairs[:, 0], return_index=True)
            items = [[sent.value[4][i] for i in own] for own in np.split(pairs[:, 1], at[1:])] if len(rows) else []
            bits = [np.packbits(hit[first[d] : first[d + 1]]).tobytes() for d in rows]
            columns = [batch.column("__row").take(pa.array(rows, pa.int64())), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["__row", "__hit", "__items"])

    return search


def _merge(text: str, kept: list[str]):
    """What several passes found, together, in the texts: a word is hit if one of them hits it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shards(batches, text):
            starts, ends, first = find_words(raw, offsets, ALNUM)
            hit = np.zeros(len(starts), bool)
            for d, own in enumerate(batch.column("__hit").to_pylist()):
                for bits in own or ():
                    hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(first[d + 1] - first[d])).astype(bool)
            found = [sorted(x or ()) for x in batch.column("__items").to_pylist()]
            yield _counted(batch, raw, offsets, starts, ends, first, hit, found, text, kept)

    return merge


def _search(sent: Broadcast, text: str, kept: list[str]):
    """The only pass: counts its hits and cuts them out."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in shards(batches, text):
            starts, ends, first, hit, pairs = search_shard(raw, offsets, sent.value)
            found = [set() for _ in range(batch.num_rows)]
            for d, i in pairs.tolist():
                found[d].add(sent.value[4][i])
            yield _counted(batch, raw, offsets, starts, ends, first, hit, [sorted(x) for x in found], text, kept)

    return search


def _counted(batch, raw, offsets, starts, ends, first, hit, found, text, kept) -> pa.RecordBatch:
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[first[1:]] - sums[first[:-1]]
    texts = batch.column(text).to_pylist()
    for d in np.flatnonzero(n_hit):
        a, b = first[d], first[d + 1]
        whole = raw[offsets[d] : offsets[d + 1]].tobytes()
        texts[d] = without_spans(whole, starts[a:b] - offsets[d], ends[a:b] - offsets[d], hit[a:b])
    columns = [*(batch.column(c) for c in kept), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "n_hit", "items", "clean_text"])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
