"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, with_fields
from .words import byte_values, text_buffer, word_hashes

CAPACITY = 2048
#: Pieces in one problem, about; its islands each hold the lengths of all of them.
PROBLEM = 8192
ISLANDS = 4
EPOCHS = 2
#: Members of an island's population; generations of an epoch at most, and those without a better best that end it.
POPULATION = 8
GENERATIONS = 200
STALLED = 10


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes are
    themselves, the others are counted from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# The pattern by which the tokenizer cuts a text, for ASCII and Latin letters in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Characters that the pattern does not cover, and the begin of the tokenizer's own marks.
_ODD = re.compile(r"[^ -~À-ÖØ-öø-įı-ɏ]|<\|")
_PROBE = "It's an Élan, isn't it? <b>\"'t Öl'\"</b> 2048% ... ŒUVRE_x'll `a~b' {c}|d"
#: What a byte is: 0 space or line feed, 1 letter, 2 digit, 3 punctuation, 4 what makes its chunk one word.
_KIND = np.array([
    0 if b in b" \n" else 2 if 48 <= b < 58 else 1 if chr(b).isalpha() and b < 128 or 0x80 <= b < 0xC0 or 0xC3 <= b < 0xCA else 3 if 33 <= b < 127 and b != 39 else 4
    for b in range(256)
], np.uint8)
_CASED, _CASELESS = byte_values(61), byte_values(67, lower=True)


class TextTokenizer:
    """Token ids of whole texts in numpy; only words that are not remembered go through the tokenizer.

    The tokenizer drops white space, and no token spans a space. It cuts the rest into pieces (words, digits,
    runs of punctuation) and looks for tokens within a piece, so a text's ids are those of its pieces, one
    after another. Pieces are found by the kinds of bytes. A chunk between spaces that holds an apostrophe or
    a character out of the pattern's reach is one word here and goes through the whole tokenizer; so does
    every chunk if a probe shows that the tokenizer cuts in another way. Words are remembered by 64-bit
    hashes, `remembered` of them and about as many ids as four each, then all are forgotten.
    """

    def __init__(self, tokenizer, remembered: int = 600_000):
        self.tokenizer, self.model, self.remembered = tokenizer, tokenizer.model, remembered
        self.letters = _byte_letters()
        probe = [i for p in _PIECE.findall(_PROBE.lower()) for i in self._model(p)]
        self.kind = _KIND if probe == self._all(_PROBE) else np.where(_KIND == 0, 0, 4).astype(np.uint8)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; word k has `count[k]` ids from `begin[k]` on
        self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _all(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _model(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def _word(self, word: bytes) -> list[int]:
        text = word.decode()
        if self.kind is not _KIND or _ODD.search(text):
            return self._all(text)
        return [i for p in _PIECE.findall(text.lower()) for i in self._model(p)]

    def _words(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the words; a word ends at an edge."""
        kind = self.kind[raw]
        kind[:-1][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = 4
        kind[:-1][(raw[:-1] == 0xC4) & (raw[1:] == 0xB0) | (raw[:-1] == 0xC9) & (raw[1:] > 0x8F)] = 4
        kind[:-1][(raw[:-1] == 60) & (raw[1:] == 124)] = 4
        cut = np.zeros(len(raw), bool)
        cut[edges] = True
        if (kind == 4).any():
            inside = kind > 0
            begins = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | cut[1:]]))
            ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | cut[1:], [True]])) + 1
            odd = np.concatenate([[0], np.cumsum(kind == 4)])
            for i, j in zip(*(x[odd[ends] > odd[begins]].tolist() for x in (begins, ends)), strict=True):
                kind[i:j] = 4
        cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut[0] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        real = kind[starts] > 0
        return starts[real], ends[real]

    def _learn(self, raw: np.ndarray, new: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data, begin, count, found = raw.tobytes(), [], [], []
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            own = self._word(data[i:j])
            begin.append(self.used + len(found))
            count.append(len(own))
            found += own
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(found)] = found
        self.used += len(found)
        at = np.searchsorted(self.hashes, new)
        self.hashes = np.insert(self.hashes, at, new)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin (and the last ones end)."""
        out, total, at = [], 0, np.zeros(len(offsets), np.int64)
        for low, high in self._slices(raw, offsets):
            part = raw[low:high]
            a, b = np.searchsorted(offsets, [low, high])
            starts, ends = self._words(part, offsets[a:b] - low)
            # the tokenizer's own marks are told from capitals
            values = _CASED if b"<|" in part.tobytes() else _CASELESS
            hashes, first, word = np.unique(word_hashes(part, starts, ends, values), return_index=True, return_inverse=True)
            known = np.zeros(len(hashes), bool)
            if len(self.hashes):
                known = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
            if not known.all():
                if len(self.hashes) + (~known).sum() > self.remembered or self.used > 4 * self.remembered:
                    self.forget()
                    known[:] = False
                self._learn(part, hashes[~known], starts[first[~known]], ends[first[~known]])
            k = np.searchsorted(self.hashes, hashes)[word]
            n = self.count[k]
            done = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            out.append(self.ids[np.repeat(self.begin[k] - done[:-1], n) + np.arange(done[-1])])
            at[a:b] = total + done[np.searchsorted(starts, offsets[a:b] - low)]
            total += int(done[-1])
        at[np.searchsorted(offsets, len(raw)) :] = total
        return np.concatenate(out) if out else np.zeros(0, np.uint32), at

    def _slices(self, raw: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Slices of about `size` bytes that end between texts or before a space, wherever texts end."""
        low = 0
        while low < len(raw):
            high = low + size
            if high >= len(raw):
                high = len(raw)
            else:
                i = int(np.searchsorted(offsets, high, side="right")) - 1
                if offsets[i] > low:
                    high = int(offsets[i])
                else:
                    end = int(offsets[i + 1])
                    spaces = np.flatnonzero(raw[high:end][: size // 4] == 32)
                    while not len(spaces) and high < end:
                        high = min(end, high + size // 4)
                        spaces = np.flatnonzero(raw[high:end][: size // 4] == 32)
                    high = high + int(spaces[0]) if len(spaces) else end
            yield low, high
            low = high


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document: its ids, then `end`, cut at CAPACITY.

    Null and empty texts are the end alone. Repeated rows and null keys give pieces of their own; very long
    texts are read in parts; an empty table gives no rows; other columns, of whatever names, are not read.
    What a task remembers of chunks is bounded in bytes and goes when the task ends.
    """
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextTokenizer(_tokenizer(tokenizer))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids, at = coder.encode(*text_buffer(part.column(1)))
                rows, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for k in range(0, b - a + 1, CAPACITY):
                        own = ids[a + k : min(b, a + k + CAPACITY)].tobytes()
                        if b - a - k < CAPACITY:
                            own += tail
                        rows.append(i)
                        piece.append(k // CAPACITY)
                        start.append(k)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(cut, with_fields(docs.select(key), "piece int, start long, length long, ids_crc32 long"))


def fill(labels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens in each bin; labels tell every item's bin."""
    return np.bincount(labels, lengths).astype(np.int64)


def place(labels: np.ndarray, spaces: list[int], items: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Puts each item into the bin that it fills best, or into a new one; spaces is the room in each bin.

    Bins are found by their room: one bit of `mask` for each room that some bin has.
    """
    by_space: dict[int, list[int]] = {}
    mask = 0
    for i, space in enumerate(spaces):
        if space:
            by_space.setdefault(space, []).append(i)
            mask |= 1 << space
    n, out = len(spaces), []
    for size in lengths[items].tolist():
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            held = by_space[space]
            i = held.pop()
            if not held:
                mask ^= 1 << space
        else:
            space, i = CAPACITY, n
            n += 1
        out.append(i)
        space -= size
        if space:
            by_space.setdefault(space, []).append(i)
            mask |= 1 << space
    labels[items] = out
    return labels


def fitness(labels: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the sum of squared fills)."""
    fills = fill(labels, lengths) / CAPACITY
    return -len(fills), float((fills**2).sum())


def first_parent(lengths: np.ndarray, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Best fit in the order of decreasing length, with the lengths blurred by up to `noise`."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    return place(np.zeros(len(lengths), np.int64), [], order, lengths)


def cross(giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of the giver go into the taker; bins of the taker that hold one of their
    documents go; the documents displaced so, and those of some bins that aren't full, are put back by best
    fit, long ones first."""
    fills = fill(giver, lengths)
    good = fills >= CAPACITY - 2
    if not good.any():
        good = fills >= np.quantile(fills, 0.8)
    chosen = good & (rng.random(len(fills)) < rng.uniform(0.3, 0.9))
    injected = chosen[giver]
    old = fill(taker, lengths)
    gone = (old < CAPACITY) & (rng.random(len(old)) < 0.5)
    gone[taker[injected]] = True
    kept = ~injected & ~gone[taker]
    out = np.zeros(len(lengths), np.int64)
    number = np.cumsum(chosen) - 1
    out[injected] = number[giver[injected]]
    first = int(chosen.sum())
    number = np.cumsum(~gone) - 1 + first
    out[kept] = number[taker[kept]]
    spaces = (CAPACITY - np.concatenate([fills[chosen], old[~gone]])).tolist()
    displaced = np.flatnonzero(~injected & ~kept)
    return place(out, spaces, displaced[np.argsort(-lengths[displaced], kind="stable")], lengths)


def least_bins(lengths: np.ndarray) -> int:
    return -(-int(lengths.sum()) // CAPACITY)


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, generations: int = GENERATIONS, stalled: int = STALLED) -> list[np.ndarray]:
    """Replaces the worst member of the population by a better child, generation after generation.

    It ends when no packing can have fewer bins, or when the best has stayed the same for `stalled`
    times the population's size of children.
    """
    ranked = sorted(((fitness(b, lengths), i, b) for i, b in enumerate(population)), key=lambda x: x[:2], reverse=True)
    since = 0
    for k in range(generations * len(ranked)):
        if len(ranked) < 2 or -ranked[0][0][0] <= least_bins(lengths) or since >= stalled * len(ranked):
            break
        a, b = rng.permutation(len(ranked))[:2]
        child = cross(ranked[a][2], ranked[b][2], lengths, rng)
        worth = fitness(child, lengths)
        since = 0 if worth > ranked[0][0] else since + 1
        if worth > ranked[-1][0]:
            ranked[-1] = (worth, -1 - k, child)
            ranked.sort(key=lambda x: x[:2], reverse=True)
    return [x[2] for x in ranked]


def found(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, size: int, noise: float) -> list[np.ndarray]:
    """The population filled up to `size` with best fits of more and more blurred orders, unless it holds a best packing."""
    out = list(population)
    for k in range(len(out), size):
        if out and min(int(b.max()) + 1 for b in out) <= least_bins(lengths):
            break
        out.append(first_parent(lengths, rng, noise * k))
    return out


def _island(seed_epoch: int, size: int):
    """One island's epoch: its own population, begun anew, with the elites that came to it."""

    def run(key: tuple, own: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        problem, island = int(key[0]), int(key[1])
        lengths = np.frombuffer(own["lengths"].iloc[0], np.int32).astype(np.int64) if len(own) else np.zeros(0, np.int64)
        if not len(lengths):
            return pd.DataFrame({"problem": [], "island": [], "bins": [], "fill": [], "labels": []})
        rng = np.random.default_rng([seed_epoch, problem, island])
        population = [np.frombuffer(x, np.int32).astype(np.int64) for x in elites["labels"]]
        best = evolve(lengths, found(lengths, population, rng, size, 0.02 * (island + 1)), rng)[0]
        n, full = fitness(best, lengths)
        return pd.DataFrame({"problem": [problem], "island": [island], "bins": [-n], "fill": [full], "labels": [best.astype(np.int32).tobytes()]})

    return run


def pack(pieces_: DataFrame, key: str = "doc_id") -> DataFrame:
    """pieces_ with sequence_id and offset: every piece in one sequence of at most CAPACITY tokens.

    Full pieces are sequences of their own. The others are dealt by a hash of their place in the table into
    problems of about PROBLEM pieces, however often a row repeats. Each problem is solved by ISLANDS that evolve apart, one task each; after an epoch the best
    packing of each island migrates to the next island of its problem; the best of all wins. What the
    winners leave in bins that are not full is pooled, many problems in one, and solved once more; so the
    unfilled bins fall from one a problem to one a pool. Equal rows get places of their own, ties of length
    are in the order of key and piece (null keys first); an empty table gives no rows; other columns are
    kept, but sequence_id, offset, problem, bin and place must not be among them. Pieces longer than CAPACITY are an error.
    """
    spark = pieces_.sparkSession
    pieces_ = checkpoint(pieces_)
    names = pieces_.columns
    whole = pieces_.filter(F.col("length") == CAPACITY)
    rest = pieces_.filter(F.col("length") < CAPACITY)
    n = rest.count()
    problems = max(1, -(-n // PROBLEM))
    dealt = rest.withColumn("problem", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(3)), F.lit(problems)))
    solved = checkpoint(_solve(dealt, key, names, 1))
    fills = solved.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
    marked = solved.join(fills, ["problem", "bin"])
    done = marked.filter(F.col("fill") == CAPACITY)
    pools = max(1, -(-problems // 64))
    loose = marked.filter(F.col("fill") < CAPACITY).select(*names, F.pmod("problem", F.lit(pools)).alias("problem"))
    repacked = _solve(loose, key, names, 2)
    lone = whole.select(*names, F.xxhash64(key, "piece", F.lit(9)).alias("problem"), F.lit(0).alias("bin"))
    # sequence ids: problems, pools and full pieces count in ranges of their own
    wide = F.lit(1 << 24)
    first = done.select(*names, (F.col("problem") * wide + F.col("bin")).alias("sequence_id"), F.col("place"))
    second = repacked.select(*names, ((F.col("problem") + problems) * wide + F.col("bin")).alias("sequence_id"), F.col("place"))
    alone = lone.select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("place"))
    alone = alone.withColumn("sequence_id", F.lit(-1).cast("long") - F.col("sequence_id"))
    return first.unionByName(second).unionByName(alone).select(*names, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("place").cast("long").alias("offset"))


def _solve(dealt: DataFrame, key: str, names: list[str], seed: int) -> DataFrame:
    """dealt (with its column problem) and bin, place: the winner of the islands of each problem."""
    order = ["length", key, "piece", "ids_crc32"]
    packed = dealt.select("problem", "length").groupBy("problem").applyInPandas(
        lambda own: pd.DataFrame({"problem": own["problem"].iloc[:1], "lengths": [np.sort(own["length"].to_numpy()).astype(np.int32).tobytes()]}),
        "problem long, lengths binary",
    )
    islands = checkpoint(packed.select("problem", "lengths", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island")))
    tasks = partitions(dealt.sparkSession)
    islands = islands.repartition(tasks, "problem", "island")
    elites = islands.select("problem", "island", F.lit(None).cast("binary").alias("labels")).filter("labels is not null")
    shape = "problem long, island int, bins long, fill double, labels binary"
    for epoch in range(EPOCHS):
        arrived = elites.repartition(tasks, "problem", "island")
        grown = islands.groupBy("problem", "island").cogroup(arrived.groupBy("problem", "island")).applyInPandas(_island(epoch + 10 * (seed - 1), POPULATION), shape)
        grown = checkpoint(grown)
        stay = grown.select("problem", "island", "labels")
        move = grown.select("problem", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), "labels")
        elites = stay.unionByName(move)
    best = grown.groupBy("problem").agg(F.max(F.struct(-F.col("bins"), F.col("fill"), F.col("island"), F.col("labels"))).alias("best"))
    best = best.select("problem", F.col("best.labels").alias("labels"))
    shape = with_fields(dealt, "bin long, place long")

    def deal(key_: tuple, own: pd.DataFrame, winner: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable")
        own["bin"] = np.frombuffer(winner["labels"].iloc[0], np.int32).astype(np.int64)
        own["place"] = own.groupby("bin")["length"].cumsum() - own["length"]
        return own

    return dealt.groupBy("problem").cogroup(best.groupBy("problem")).applyInPandas(deal, shape)
