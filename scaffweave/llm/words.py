"""Words and their hashes for whole Arrow batches of texts, in numpy, without one Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = (0x20, *range(0x09, 0x0E))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _lut(word_byte) -> np.ndarray:
    return np.array([word_byte(b) for b in range(256)], dtype=bool)


#: Words between ASCII white space.
SPACED = _lut(lambda b: b not in _SPACE)
#: Words of ASCII digits and letters and of all that is not ASCII.
ALNUM = _lut(lambda b: b >= 0x80 or chr(b).isalnum())
#: Lower-cases A-Z and leaves all else.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def byte_values(seed: int, lower: bool = False) -> np.ndarray:
    """A random odd number for each byte value; with lower, the same for a letter in either case."""
    values = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values[LOWER] if lower else values


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes of text each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def find_words(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
    """Byte starts and ends of the words, and the first word of each row (and the end of the last)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = word_byte[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1] | edge[1:-1]
    end[:-1] &= ~flags[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
        for name, factor in (("up", _FACTOR), ("down", inverse)):
            steps = np.full(max(n, 1 << 20), factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: differences of one running polynomial over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def rolling(h: np.ndarray, width: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hashes of all runs of `width` neighbours, built from runs of powers of two."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, step, size = None, 0, h, 1
    while size <= width:
        if width & size:
            if out is None:
                out = step[: len(h) - size + 1]
            else:
                keep = len(h) - covered - size + 1
                out = out[:keep] * np.uint64(pow(factor, size, 1 << 64)) + step[covered : covered + keep]
            covered += size
        if size * 2 <= width:
            keep = len(h) - 2 * size + 1
            step = step[:keep] * np.uint64(pow(factor, size, 1 << 64)) + step[size : size + keep]
        size *= 2
    return mix(out)


def room(first: np.ndarray) -> np.ndarray:
    """For each word, the words from it to the end of its row."""
    n = int(first[-1] - first[0])
    return np.repeat(first[1:], np.diff(first)) - np.arange(n)
