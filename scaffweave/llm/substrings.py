"""Exact substring dedup by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, total_bytes, with_fields
from .words import SPACED, byte_values, find_words, rolling, room, runs, text_buffer, word_hashes

WINDOW = 50
#: Reference blocks: every run of 50 words holds a whole one that begins at a multiple of 25.
BLOCK = 25
#: Text of one chunk of documents, and anchors of one bucket, about.
CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 2 << 20
_VALUES, _OTHER = byte_values(61), byte_values(67)
_MASK = np.uint64((1 << 46) - 1)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, first all lowest bytes, and so on: constant ones compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplane(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with h, so rows in the order of h are in the order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _chunk_words(table: pa.Table, text: str, *values: np.ndarray):
    """Word hashes of a chunk's documents, and each document's first word."""
    raw, offsets = text_buffer(table.column(text))
    hashes, first, seen = [[] for _ in values], [np.zeros(1, np.int64)], 0
    for lo, hi in runs(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, own = find_words(part, offsets[lo : hi + 1] - offsets[lo], SPACED)
        for out, v in zip(hashes, values, strict=True):
            out.append(word_hashes(part, starts, ends, v))
        first.append(own[1:] + seen)
        seen += len(starts)
    return [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes], np.concatenate(first)


def _anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of BLOCK words in documents with a window, where they begin, and which are
    reference blocks."""
    left = room(first)
    sizes = np.repeat(np.diff(first), np.diff(first))
    at = np.flatnonzero((left >= BLOCK) & (sizes >= WINDOW))
    return rolling(h, BLOCK)[at], at, (sizes[at] - left[at]) % BLOCK == 0


def _probe(text: str, buckets: int):
    def probe(table: pa.Table) -> pa.Table:
        (h,), first = _chunk_words(table, text, _VALUES)
        key, at, block = _anchors(h, first)
        order = np.argsort(key, kind="stable")
        key, at, block = key[order], at[order], block[order]
        if not len(key):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        doc = np.searchsorted(first, at, side="right")
        last = np.append(heads[1:], len(key)) - 1
        some = np.logical_or.reduceat(block, heads)
        several = doc[heads] != doc[last]
        key = key[heads]
        packed = ((key & _MASK) << np.uint64(2)) | (some.astype(np.uint64) << np.uint64(1)) | several.astype(np.uint64)
        bucket = _bucket(key, buckets)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        own = np.flatnonzero(np.diff(cut))
        blobs = [_six(packed[cut[b] : cut[b + 1]]) for b in own]
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(own, pa.int64()), "chunk": pa.array([chunk] * len(own), pa.int64()), "keys": pa.array(blobs, pa.binary())})

    return probe


def _match(table: pa.Table) -> pa.Table:
    """For each chunk, its anchors in this bucket that are a reference block and stand in two documents."""
    parts = [_unsix(x.as_py()) for x in table.column("keys")]
    sizes = np.array([len(p) for p in parts])
    packed = np.concatenate(parts)
    source = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(packed >> np.uint64(2), kind="stable")
    key, flags, source = (packed >> np.uint64(2))[order], (packed & np.uint64(3))[order], source[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(heads, len(key)))
    flag = np.bitwise_or.reduceat(flags, heads)
    hit = np.repeat(((flag & np.uint64(2)) > 0) & ((count > 1) | ((flag & np.uint64(1)) > 0)), count)
    key, source = key[hit], source[hit]
    order = np.argsort(source, kind="stable")
    key, cut = key[order], np.searchsorted(source[order], np.arange(len(parts) + 1))
    own = np.flatnonzero(np.diff(cut))
    chunks = table.column("chunk").to_numpy()
    return pa.table({"chunk": pa.array(chunks[own], pa.int64()), "keys": pa.array([_six(key[cut[i] : cut[i + 1]]) for i in own], pa.binary())})


def _windows(h: np.ndarray, g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin, and two independent hashes of each."""
    at = np.flatnonzero(room(first) >= WINDOW)
    return at, rolling(h, WINDOW)[at], rolling(g, WINDOW)[at]


def _extend(key: str, text: str, buckets: int):
    def extend(docs: pa.Table, hits: pa.Table) -> pa.Table:
        """The windows around a chunk's hits, as (bucket, hash, smallest id, whether several ids)."""
        none = {"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "low": pa.array([], pa.binary()), "several": pa.array([], pa.binary())}
        if not docs.num_rows or not hits.num_rows:
            return pa.table(none)
        (h, g), first = _chunk_words(docs, text, _VALUES, _OTHER)
        anchor, at, _ = _anchors(h, first)
        wanted = np.sort(np.concatenate([_unsix(x.as_py()) for x in hits.column("keys")]))
        k = anchor & _MASK
        found = wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k
        count = np.zeros(len(h) + BLOCK + 2, np.int64)
        count[at[found] + 1] = 1
        count = np.cumsum(count)
        begin, a, b = _windows(h, g, first)
        near = count[begin + BLOCK + 1] > count[begin]
        begin, a, b = begin[near], a[near], b[near]
        if not len(begin):
            return pa.table(none)
        ids = docs.column(key).to_numpy()
        doc = ids[np.searchsorted(first, begin, side="right") - 1]
        bucket = _bucket(a, buckets)
        order = np.lexsort((b, bucket))
        bucket, b, doc = bucket[order], b[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (bucket[1:] != bucket[:-1])]))
        low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
        bucket, b = bucket[heads], b[heads]
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        own = np.flatnonzero(np.diff(cut))
        span = [(cut[i], cut[i + 1]) for i in own]
        return pa.table(
            {
                "bucket": pa.array(own, pa.int64()),
                "chunk": pa.array([docs.column("chunk")[0].as_py()] * len(own), pa.int64()),
                "keys": pa.array([_planes(b[x:y]) for x, y in span], pa.binary()),
                "low": pa.array([_planes(low[x:y]) for x, y in span], pa.binary()),
                "several": pa.array([np.packbits(low[x:y] != high[x:y]).tobytes() for x, y in span], pa.binary()),
            }
        )

    return extend


def _first_owner(table: pa.Table) -> pa.Table:
    """For each chunk, its windows in this bucket that another document has too, with their smallest id."""
    keys = [_unplane(x.as_py()) for x in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    key, source = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
    low = np.concatenate([_unplane(x.as_py(), np.int64) for x in table.column("low")])
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(table.column("several"), sizes, strict=True)]).astype(bool)
    order = np.argsort(key, kind="stable")
    key, source, low, several = key[order], source[order], low[order], several[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(np.minimum.reduceat(low, heads), np.diff(np.append(heads, len(key))))
    told = several | (least < low)
    key, source, least = key[told], source[told], least[told]
    order = np.argsort(source, kind="stable")
    key, least, cut = key[order], least[order], np.searchsorted(source[order], np.arange(len(keys) + 1))
    own = np.flatnonzero(np.diff(cut))
    chunks = table.column("chunk").to_numpy()
    return pa.table(
        {
            "chunk": pa.array(chunks[own], pa.int64()),
            "keys": pa.array([_planes(key[cut[i] : cut[i + 1]]) for i in own], pa.binary()),
            "low": pa.array([_planes(least[cut[i] : cut[i + 1]]) for i in own], pa.binary()),
        }
    )


def _remove(key: str, text: str, kept: list[str], with_text: bool):
    def remove(docs: pa.Table, owners: pa.Table) -> pa.Table:
        (h, g), first = _chunk_words(docs, text, _VALUES, _OTHER)
        cover = np.zeros(len(h) + 1, np.int64)
        if owners.num_rows and len(h):
            wanted = np.concatenate([_unplane(x.as_py()) for x in owners.column("keys")])
            low = np.concatenate([_unplane(x.as_py(), np.int64) for x in owners.column("low")])
            order = np.argsort(wanted)
            wanted, low = wanted[order], low[order]
            begin, _, b = _windows(h, g, first)
            place = np.minimum(np.searchsorted(wanted, b), len(wanted) - 1)
            doc = docs.column(key).to_numpy()[np.searchsorted(first, begin, side="right") - 1]
            gone = begin[(wanted[place] == b) & (low[place] < doc)]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
        removed = np.cumsum(cover[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(removed)])
        n_removed = sums[first[1:]] - sums[first[:-1]]
        digests, texts = [], []
        for i, x in enumerate(docs.column(text).to_pylist()):
            words = (x or "").encode().split()
            if n_removed[i]:
                words = [w for w, r in zip(words, removed[first[i] : first[i + 1]].tolist(), strict=True) if not r]
            joined = b" ".join(words)
            digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                texts.append(joined.decode() if n_removed[i] else x)
        out = docs.select(kept)
        out = out.append_column("n_words", pa.array(np.diff(first), pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))
        out = out.append_column("kept_sha256", pa.array(digests, pa.string()))
        return out.append_column("kept_text", pa.array(texts, pa.string())) if with_text else out

    return remove


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256, and with_text kept_text (the text itself if nothing goes).

    A word goes if a run of 50 words that covers it also starts in a document with a smaller key. Documents
    are dealt into chunks of about 8 MB by a hash of key and text, so a key of very many rows is not one chunk. (1) Every chunk sends its rolling runs of 25
    words, one entry for each different run, to buckets of hash ranges, with a mark on the reference blocks
    (runs at multiples of 25); (2) a bucket tells each chunk which of its runs equal a reference block and
    stand in two documents; (3) chunks extend these hits to all windows of 50 words around them and send
    their fingerprints (64 bits, and the bucket's bits of another hash) with the smallest key; (4) buckets
    tell the smallest key of all; (5) chunks merge the windows owned by a smaller key to the maximal repeats
    and cut them. However many documents share a run, a chunk sends it once, so a hot passage costs a
    bucket one entry a chunk. The text is shuffled once and used by (1), (3) and (5).

    Null and short texts keep all their (no) words; rows that repeat a key are one document to each other,
    and lose nothing to each other; a null key counts as the largest. Columns named like the results, or
    `chunk`, are replaced. An empty table gives no rows.
    """
    new = ("n_words", "n_removed", "kept_sha256", "kept_text", "chunk")
    kept = [c for c in docs.columns if c not in new]
    if not with_text:
        kept = [c for c in kept if c != text]
    shuffles = partitions(docs.sparkSession)
    size = total_bytes(docs, text)
    chunks = max(4 * shuffles, -(-size // CHUNK_BYTES))
    buckets = max(shuffles, -(-size // (6 * BUCKET_WORDS)))
    last = F.lit(2**63 - 1)
    columns = [*kept, *([] if text in kept else [text])]
    placed = docs.select(*columns, F.coalesce(F.col(key), last).alias("__key"), F.pmod(F.xxhash64(F.lit("chunk"), key, text), F.lit(chunks)).alias("chunk"))
    placed = placed.repartition(shuffles, "chunk")
    probes = placed.groupBy("chunk").applyInArrow(_probe(text, buckets), "bucket long, chunk long, keys binary")
    hits = probes.groupBy("bucket").applyInArrow(_match, "chunk long, keys binary")
    windows = placed.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend("__key", text, buckets), "bucket long, chunk long, keys binary, low binary, several binary")
    owners = windows.groupBy("bucket").applyInArrow(_first_owner, "chunk long, keys binary, low binary")
    shape = with_fields(docs.select(*kept), "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return placed.groupBy("chunk").cogroup(owners.groupBy("chunk")).applyInArrow(_remove("__key", text, kept, with_text), shape)
