"""Exact search of the k largest inner products in an impact-ordered index, score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

#: Vectors of one index at most, and at least where there are fewer tasks than that gives.
SHARD = 1 << 16
LEAST = 1 << 13
#: Neighbouring integer components that share a posting segment.
WIDTH = 4
#: Shares of the largest impact down to which postings are taken, one band after another; the last takes all.
BANDS = (0.4, 0.1, 0.0, -0.1, -0.4, -np.inf)
#: One in so many rows is few enough to be rescored rather than bounded further.
FEW = 8
#: Largest integer component; larger ones count as this one, so that all sums are exact in double precision.
LIMIT = 1 << 20


class ImpactIndex:
    """Postings of integer vectors by dimension, in the order of quantised components.

    A segment holds the rows whose component of a dimension has one level (WIDTH neighbouring integers). For a query
    its impact is the largest product that a row in it can have.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        floor = vectors // WIDTH * WIDTH
        self.order = np.ascontiguousarray(np.argsort(-floor, axis=0, kind="stable").T.astype(np.int32))
        self.floor = np.ascontiguousarray(np.take_along_axis(floor.T, self.order, 1).astype(np.float64))

    def top(self, query: np.ndarray, k: int, own: int = -1, ties: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k rows with the largest inner products, and these; of equal ones the smaller tie, then the earlier row.

        Bands of segments are taken by descending impact and added up to each row's bound: what the taken segments
        can give, and for each dimension what the next segment could. A row whose bound is below the k-th best
        exact product seen so far cannot be among the k. Once few rows are left, or all segments are taken, all
        that are left get their exact products. `own` is a row that takes no part.
        """
        n = len(self.vectors)
        use = np.flatnonzero(query) if n else np.zeros(0, np.int64)
        q = query[use].astype(np.float64)
        up, edge = q > 0, np.where(q > 0, WIDTH - 1.0, 0.0)
        taken = np.zeros(len(use), np.int64)
        bound = np.zeros(n)
        left = np.arange(n)
        top = self._next(use, q, up, edge, taken).max(initial=0)
        best, known = -np.inf, {}
        if own >= 0:
            bound[own] = -np.inf
        for share in BANDS if top > 0 else ():
            upto = np.maximum(taken, self._reach(use, q, up, edge, share * top))
            bound += self._band(use, q, up, edge, taken, upto)
            taken = upto
            rest = np.maximum(self._next(use, q, up, edge, taken), 0).sum()
            seen = np.argpartition(-bound, k)[: k + 1] if n > k + 1 else np.arange(n)
            for r in seen[seen != own].tolist():
                if r not in known:
                    known[r] = float(self.vectors[r] @ query)
            if len(known) >= k:
                best = max(best, sorted(known.values())[-k])
            left = np.flatnonzero(bound + rest >= best)
            if len(left) <= max(4 * k, n // FEW):
                break
        left = left[left != own]
        score = self.vectors[left].astype(np.float64) @ query.astype(np.float64)
        tie = left if ties is None else ties[left]
        pick = np.lexsort((left, tie, -score))[:k]
        return left[pick], score[pick].astype(np.int64)

    def _reach(self, use: np.ndarray, q: np.ndarray, up: np.ndarray, edge: np.ndarray, low: float) -> np.ndarray:
        """How many postings of each dimension have an impact of `low` or more, from the end that the sign of q takes first."""
        n = self.floor.shape[1]
        least, most = np.zeros(len(use), np.int64), np.full(len(use), n, np.int64)
        while (least < most).any():
            middle = (least + most) // 2
            at = np.minimum(np.where(up, middle, n - 1 - middle), n - 1)
            within = (self.floor[use, at] + edge) * q >= low
            open_ = least < most
            least = np.where(open_ & within, middle + 1, least)
            most = np.where(open_ & ~within, middle, most)
        return least

    def _band(self, use: np.ndarray, q: np.ndarray, up: np.ndarray, edge: np.ndarray, taken: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """What the postings from `taken` to `upto` of each dimension add to the rows."""
        n = self.floor.shape[1]
        size = upto - taken
        begin = use * n + np.where(up, taken, n - upto)
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.bincount(self.order.ravel()[at], (self.floor.ravel()[at] + np.repeat(edge, size)) * np.repeat(q, size), n)

    def _next(self, use: np.ndarray, q: np.ndarray, up: np.ndarray, edge: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """The impact of the next segment of each dimension, 0 where none is left."""
        n = self.floor.shape[1]
        at = np.clip(np.where(up, taken, n - 1 - taken), 0, max(n - 1, 0))
        return np.where(taken < n, (self.floor[use, at] + edge) * q, 0) if n else np.zeros(0)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches hold shards one after another; the vectors of a shard stand before the queries that ask it."""
        shard, parts, index, rows, keys, nulls = None, [], None, None, None, None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("size", "shard", "asked")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                part, name, asked = batch.slice(low, high - low), tuple(at[:2, low]), at[2, low]
                if name != shard:
                    shard, parts, index = name, [], None
                if not asked:
                    parts.append(part)
                    continue
                if index is None:
                    if not parts:
                        continue
                    table = pa.Table.from_batches(parts).combine_chunks()
                    rows, key = table.column("row").to_numpy(), table.column("vec").combine_chunks()
                    nulls = key.is_null().to_numpy(zero_copy_only=False)
                    keys = key.fill_null(0).to_numpy()
                    index = ImpactIndex(_matrix(table.column("code").combine_chunks()).astype(np.int64))
                    ties = np.empty(len(keys), np.int64)
                    ties[np.lexsort((keys, nulls))] = np.arange(len(keys))
                    order = np.argsort(rows)
                    parts = [None]
                query_rows, ids = part.column("row").to_numpy(), part.column("vec").to_numpy()
                where = order[np.minimum(np.searchsorted(rows[order], query_rows), len(rows) - 1)]
                out = []
                for i, q in enumerate(_matrix(part.column("code")).astype(np.int64)):
                    found, score = index.top(q, k, int(where[i]) if rows[where[i]] == query_rows[i] else -1, ties)
                    out.append((np.full(len(found), query_rows[i]), np.full(len(found), ids[i]), found, score))
                asking, query, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asking), pa.array(query), pa.array(keys[found], mask=nulls[found]), pa.array(rows[found]), pa.array(score)], names=["asking", "query_id", "vec_id", "found", "score"]
                )

    return search


def exact_top_k(vectors: DataFrame, asked: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `asked` holds for, the k other rows with the largest inner
    products of floor(scale * component), all of them if there are fewer; of equal scores the smaller key first.

    Vectors are dealt by a hash into shards of at most about SHARD, each with an impact-ordered index, and every
    query asks every shard, one after another past an index that is built once. A shard returns its exact k best,
    and the best k of these are the result; k rows a shard and query meet in the end.

    Vectors that are null or hold null or non-finite components take no part. Those of different lengths are not
    compared. Repeated rows are rows of their own, also to each other; null keys are found last among equal
    scores and ask only if `asked` is true for them. Components beyond LIMIT / scale count as that. An empty
    table gives no rows; other columns are only seen by `asked`.
    """
    spark = vectors.sparkSession
    x = F.col("__v")
    whole = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    code = F.transform(x, lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    rows = vectors.select(F.col(key).cast("long").alias("vec"), F.col(embedding).cast("array<double>").alias("__v"), F.coalesce(asked, F.lit(False)).alias("asks"))
    rows = rows.filter(x.isNotNull() & whole).select(F.monotonically_increasing_id().alias("row"), "vec", "asks", F.size("__v").alias("size"), code.alias("code"))
    rows = checkpoint(rows)
    n = rows.count()
    shards = max(-(-n // SHARD), min(2 * partitions(spark), -(-n // LEAST)), 1)
    columns = ["size", "shard", "asked", "row", "vec", "code"]
    stored = rows.withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(shards)), "asked": F.lit(0)}).select(*columns)
    queries = rows.filter("asks").withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))), "asked": F.lit(1)}).select(*columns)
    dealt = stored.unionByName(queries).repartition(partitions(spark), "size", "shard").sortWithinPartitions("size", "shard", "asked")
    found = dealt.mapInArrow(_search(k), "asking long, query_id long, vec_id long, found long, score long")
    place = Window.partitionBy("asking").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")
    best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
