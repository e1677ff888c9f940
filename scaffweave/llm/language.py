"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, with_fields
from .words import runs, text_buffer

DIM = 1024
#: Documents of each language that prototypes are bundled from, at most (chosen by a hash of the id).
SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"
_SYMBOLS = 128
#: Trigrams whose vectors are held at a time.
_ROWS = 2048


class Encoder:
    """Document vectors: each trigram of letters is the product of its letters' random vectors, the
    first permuted twice and the second once; a document bundles (adds) the vectors of its trigrams.

    A letter's vector depends on its code point alone, so all tasks and all scripts agree. Texts of at most
    127 different letters look their trigrams' vectors up in a table of `remembered` rows of one byte a
    component; other texts (of large scripts, or a mix of many) have them worked out in blocks.
    """

    def __init__(self, seed: int = 11, dim: int = DIM, remembered: int = 40_000):
        self.seed, self.dim, self.remembered = seed, dim, remembered
        self.table = np.zeros((remembered, dim), np.int8)
        self.row = np.full(_SYMBOLS**3, -1, np.int32)
        self.symbol = np.full(0x110000, -1, np.int32)
        self.forget()

    def forget(self) -> None:
        """Back to no known letter and no known trigram."""
        self.symbol[:] = -1
        self.own: dict[int, int] = {}
        self.vectors = np.ones((_SYMBOLS, self.dim), np.int8)  # 0 stands for no letter
        self.forget_rows()

    def forget_rows(self) -> None:
        self.row[:] = -1
        self.known = 0

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Numbers of the letters, upper and lower case alike; 0 for what is no letter."""
        out = self.symbol[points]
        if (out < 0).any():
            new = np.unique(points[out < 0]).tolist()
            if len(self.own) + len(new) > 0x4000:
                self.forget()
                new = np.unique(points).tolist()
            for c in new:
                low = chr(c).lower()[0]
                self.symbol[c] = self._number(ord(low)) if low.isalpha() else 0
            out = self.symbol[points]
        return out

    def _number(self, letter: int) -> int:
        if letter not in self.own:
            k = self.own[letter] = len(self.own) + 1
            if k >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.ones_like(self.vectors)])
            self.vectors[k] = np.random.default_rng([self.seed, letter]).choice(np.array([-1, 1], np.int8), self.dim)
        return self.own[letter]

    def _bind(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = self.vectors
        return np.roll(v[a], 2, axis=1) * np.roll(v[b], 1, axis=1) * v[c]

    def _learn(self, codes: np.ndarray) -> bool:
        """Puts the trigrams into the table; False if they are too many for it."""
        new = np.unique(codes[self.row[codes] < 0])
        if self.known + len(new) > self.remembered:
            self.forget_rows()
            new = np.unique(codes)
            if len(new) > self.remembered:
                return False
        for low in range(0, len(new), _ROWS):
            part = new[low : low + _ROWS]
            at = self.known + np.arange(len(part))
            self.table[at] = self._bind(part // _SYMBOLS**2, part // _SYMBOLS % _SYMBOLS, part % _SYMBOLS)
            self.row[part] = at
            self.known += len(part)
        return True

    def _bundle(self, seen: np.ndarray, counts: np.ndarray, rows) -> np.ndarray:
        out = np.zeros(self.dim, np.float32)
        for low in range(0, len(seen), _ROWS):
            out += counts[low : low + _ROWS].astype(np.float32) @ rows(seen[low : low + _ROWS]).astype(np.float32)
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts, and which texts have a letter (the others' vectors are 0)."""
        n = len(offsets) - 1
        out, lettered = np.zeros((n, self.dim), np.float32), np.zeros(n, bool)
        for lo, hi in runs(offsets):
            part = raw[offsets[lo] : offsets[hi]]
            if not len(part):
                continue
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[lo : hi + 1] - offsets[lo]]
            symbols = self._symbols(points)
            small = len(self.own) < _SYMBOLS
            doc_start = np.zeros(len(points) + 1, bool)
            doc_start[chars] = True
            left = np.concatenate([[0], symbols[:-1]])
            right = np.concatenate([symbols[1:], [0]])
            left[doc_start[:-1]] = 0
            right[doc_start[1:]] = 0
            base = _SYMBOLS if small else 1 << 20
            left, symbols, right = (x.astype(np.int32 if small else np.int64) for x in (left, symbols, right))
            codes = (left * base + symbols) * base + right
            real = symbols > 0
            places = np.concatenate([[0], np.cumsum(real)])[chars]
            codes = codes[real]
            ids = self.row[codes] if small and self._learn(codes) else None
            for i in range(hi - lo):
                a, b = places[i], places[i + 1]
                if a == b:
                    continue
                if ids is not None:
                    counts = np.bincount(ids[a:b])
                    seen = np.flatnonzero(counts)
                    v = self._bundle(seen, counts[seen], lambda k: self.table[k])
                else:
                    seen, counts = np.unique(codes[a:b], return_counts=True)
                    v = self._bundle(seen, counts, lambda k: self._bind(k // base**2, k // base % base, k % base))  # noqa: B023
                size = float(np.linalg.norm(v))
                out[lo + i] = v / size if size else v
                lettered[lo + i] = True
        return out, lettered


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that few vectors are held."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def fit_prototypes(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the bundles of at most about `per_language` documents of each.

    Spark adds the vectors up by (language, dimension); only those sums reach the driver.
    """
    known = docs.filter(F.col(lang).isNotNull() & ~held_out(key))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_language / n) * 2**31))])
    chosen = known.filter(F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(2**31)) < F.element_at(share, F.col(lang)))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in _slices(batches):
            vectors, _ = encoder.encode(*text_buffer(batch.column(1)))
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = (
        chosen.select(F.col(lang).alias("lang"), text).mapInArrow(bundle, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    )
    names = sorted({r[0] for r in rows})
    out = np.zeros((len(names), DIM))
    for name, i, x in rows:
        out[names.index(name), i] = x
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return names, (out / np.where(size > 0, size, 1)).astype(np.float32)


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with lang_pred and score.

    lang_pred is the language whose prototype has the largest cosine with the document (the first in
    alphabetical order of equal ones), score that cosine, 0 at least. Null texts and texts with no letter
    are `und` with score 0, and so is every text if no language is known. Very long texts are read whole. Repeated
    rows are judged alike; an empty table gives no rows; columns named like the results are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    names, prototypes = model
    labels = np.array([*names, UNKNOWN], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in _slices(batches):
            vectors, lettered = encoder.encode(*text_buffer(batch.column(0)))
            if len(names):
                cosine = vectors @ prototypes.T
                best = cosine.argmax(1)
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                best = np.where(lettered, best, len(names))
            else:
                best, score = np.zeros(len(lettered), np.int64), np.zeros(len(lettered))
            columns = [*batch.columns[1:], pa.array(labels[best].tolist(), pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    shape = with_fields(docs.select(*kept), "lang_pred string, score double")
    return docs.select(F.col(text).alias("__text"), *kept).mapInArrow(judge, shape)
