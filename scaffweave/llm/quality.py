"""Quality classification with supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learning_texts, sample_by_hash, with_fields
from .words import SPACED, byte_values, find_words, mix, runs, text_buffer, word_hashes

#: Rows of the embedding table that words and n-grams are hashed into.
BUCKETS = 1 << 17
DIM = 12
#: Labelled documents that the model is trained on, at most (chosen by a hash of the id).
SAMPLE = 4000
EPOCHS = 4
_VALUES = byte_values(29)
_GRAMS = (2, 3, 4)


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (buckets, begin, end): words, neighbouring words, and n-grams of characters.

    An n-gram lies within a word and its two borders. Characters are counted, not bytes. Skip-grams span two
    neighbouring words: the two first characters of both, and the two last of both.
    """
    buckets = np.uint64(BUCKETS - 1)
    starts, ends, first = find_words(raw, offsets, SPACED)
    words = word_hashes(raw, starts, ends, _VALUES)
    two = mix(words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:]) if len(words) > 1 else words[:0]
    out = [((words & buckets).astype(np.int32), first[:-1], first[1:])]
    pair_begin = np.minimum(first[:-1], len(two))
    pair_end = np.maximum(pair_begin, first[1:] - 1)
    out.append(((two & buckets).astype(np.int32), pair_begin, pair_end))
    # code points, with one space for any run of white space: the border of both its words
    points = np.frombuffer(raw.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.searchsorted(lead, offsets)
    if len(words) > 1:
        low, high = np.searchsorted(lead, starts), np.searchsorted(lead, ends) - 1
        long = high > low
        for near, next_ in ((low, np.where(long, low + 1, low)), (high, np.where(long, high - 1, high))):
            tip = mix(points[near].astype(np.uint64) << np.uint64(32) | points[next_] * long)
            skip = mix(tip[:-1] * np.uint64(0x9E3779B97F4A7C15) + tip[1:] + np.uint64(1))
            out.append(((skip & buckets).astype(np.int32), pair_begin, pair_end))
    space = ~SPACED[raw[lead]]
    begins = np.zeros(len(points) + 1, bool)
    begins[at] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = True
    keep |= begins[:-1]
    places = np.concatenate([[0], np.cumsum(keep)])[at]
    code = np.where(space, 32, points)[keep].astype(np.uint32)
    gap, head = space[keep], begins[:-1][keep]
    h = (code + np.uint32(1)) * np.uint32(0x9E3779B1)
    gram, inner, cut = h, np.zeros(len(code), bool), np.zeros(len(code), bool)
    for n in range(2, max(_GRAMS) + 1):
        if len(code) < n:
            break
        # a gap may be the first or last character of a gram, not one between; nor may a gram reach into the next text
        inner = (inner[:-1] | gap[n - 2 : -1]) if n > 2 else np.zeros(len(code) - 1, bool)
        cut = cut[:-1] | head[n - 1 :]
        gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(13))) * np.uint32(0x85EBCA6B) + h[n - 1 :]
        if n in _GRAMS:
            good = ~inner & ~cut
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            number = np.concatenate([[0], np.cumsum(good)])
            own = np.minimum(places, len(good))
            out.append(((mixed[good] >> np.uint32(32 - 17)).astype(np.int32), number[own[:-1]], number[own[1:]]))
    return out


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS, rate: float = 0.5) -> dict:
    """Softmax over a text's vector, by stochastic gradient descent, one text at a time.

    The vector is the mean over the kinds of features of the mean of that kind's vectors.
    """
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = []
    for x in texts:
        raw = np.frombuffer(x.encode(), np.uint8)
        groups = [f[b[0] : e[0]] for f, b, e in features(raw, np.array([0, len(raw)])) if e[0] > b[0]]
        parts = [np.full(len(f), 1 / (len(f) * len(groups))) for f in groups]
        seen, at = np.unique(np.concatenate([*groups, np.zeros(0, np.int32)]), return_inverse=True)
        bags.append((seen, np.bincount(at, np.concatenate([*parts, np.zeros(0)]), len(seen)).astype(np.float32)))
    counts = np.bincount(labels, minlength=2)
    balance = np.where(counts > 0, len(labels) / np.maximum(1, 2 * counts), 0) ** 0.5
    steps, total = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            seen, share = bags[i]
            if not len(seen):
                continue
            rows = table[seen]
            hidden = share @ rows
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = np.float32(rate * (1 - steps / total) * balance[labels[i]])
            back = out.T @ p
            out -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            # a text's vectors share its gradient by their counts; scaled so that texts of any length learn alike
            table[seen] = rows - step * len(seen) ** 0.5 * share[:, None] * back[None, :]
            steps += 1
    prior = float((counts[1] + 1) / (counts.sum() + 2))
    return {"weights": (table @ (out[1] - out[0])).astype(np.float32), "bias": float(bias[1] - bias[0]), "prior": prior}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> dict:
    """A model from at most about `bound` labelled documents that are not held out; an even prior if there are none.

    Of rows that repeat a key or a text, each different (label, text) counts once, and of one key's at most
    KEY_ROWS, with their first LEARNED characters, and not more than LEARN_BYTES in all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).alias("y"))
    chosen = sample_by_hash(known.groupBy(key).agg(F.max("y").alias("y")), key, bound)
    return train(*learning_texts(docs, chosen, key, text, bound))


def score_quality(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with score, the softmax probability of label 1.

    The mean of feature vectors times the output weights is the mean of their scalar products, which are worked out once for the table. Null and empty texts have no feature and score the
    label's share in training. Very long texts are read whole; a score hangs on the text alone, so ties and
    repeated rows score alike; an empty table gives no rows; a column named score is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, prior = sent.value["weights"], sent.value["bias"], sent.value["prior"]
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            score = np.full(batch.num_rows, prior)
            for lo, hi in runs(offsets):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for f, begin, end in features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    sums = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
                    total += (sums[end] - sums[begin]) / np.maximum(1, end - begin)
                    n += end > begin
                some = n > 0
                score[lo:hi][some] = 1 / (1 + np.exp(-(total[some] / n[some] + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names=[*kept, "score"])

    shape = with_fields(docs.select(*kept), "score double")
    return docs.select(F.col(text).alias("__text"), *kept).mapInArrow(judge, shape)
