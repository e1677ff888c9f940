"""Near-duplicate vectors by NN-descent, with threshold edges kept."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, partitions
from .minhash import _groups, link

COSINE = 0.95
#: Neighbours in a list while the graph is refined, and rows of one run that are compared with each other.
NEIGHBOURS = 10
RUN = 256
#: Random orders that the first graph is taken from; rounds of refinement at most.
TABLES = 6
ROUNDS = 4
#: Pairs so little below the threshold are edges too; links are decided when they are counted.
SLACK = 1e-9
#: Vectors of one cell of exact counting; larger components are counted in pairs of such blocks.
CELL = 256
#: Linked vectors whose links the audit counts by brute force, and the share of them that must have been found.
AUDIT = 256
RECALL = 0.98
#: Vectors that the audit looks through for linked ones, at most, and so many at once.
ASKED = 8192
ASKED_AT_ONCE = 1024
#: Graphs that are built; if the last one fails the audit too, all vectors are compared.
BUILDS = 3


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; none for null, empty, zero or non-finite ones."""
    for batch in batches:
        column = batch.column(1)
        values = column.values.to_numpy(zero_copy_only=False)  # null components are not numbers there
        bounds, nulls, out = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False), []
        for i in range(batch.num_rows):
            x = values[bounds[i] : bounds[i + 1]]
            if nulls[i] or not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
                out.append(None)
            else:
                x = x / top
                out.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec", "unit"])


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each table, with the signs of random projections and one projection more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for t in range(tables):
            x = _matrix(batch.column(1))
            planes = np.random.default_rng([seed, t, x.shape[1]]).standard_normal((x.shape[1], 17))
            seen = x @ planes
            code = ((seen[:, :16] > 0) << np.arange(16)).sum(1) + (t << 16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64()), pa.array(seen[:, 16])], names=["rep", "unit", "group", "code", "along"])


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `near` that link all that it links, at most one for each row."""
    a, b = [], []
    left = np.flatnonzero(near.any(1))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near[i, left]
            a.extend(left[hit].tolist())
            b.extend([i] * int(hit.sum()))
            queue.extend(left[hit].tolist())
            left = left[~hit]
    return np.array(a, np.int64), np.array(b, np.int64)


def _best(rows: np.ndarray, group: np.ndarray, x: np.ndarray, bar: np.ndarray, k: int, cosine: float):
    """For each row its k best others above its bar, and a forest of all pairs at the threshold; none of one group."""
    c = x @ x.T
    c[group[:, None] == group[None, :]] = -2
    k = min(k, len(rows) - 1)
    near = np.argpartition(-c, k - 1, axis=1)[:, :k]
    cos = np.take_along_axis(c, near, 1)
    a, b = np.nonzero(cos > bar[:, None])
    i, j = _forest(c >= cosine - SLACK)
    return np.concatenate([rows[a], rows[i]]), np.concatenate([rows[near[a, b]], rows[j]]), np.concatenate([cos[a, b], c[i, j]])


def _compare(k: int, by: str | None, cosine: float):
    """Pairs within runs of at most RUN neighbouring rows (of one centre, if `by` names it)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sorted_runs():
            if by:
                for group in _groups(batches, by, "part"):
                    for low in range(0, group.num_rows, 2 * RUN):
                        yield group.slice(low, 2 * RUN)
            else:
                for batch in batches:
                    for low in range(0, batch.num_rows, RUN):
                        yield batch.slice(low, RUN)

        a, b, c, held = [], [], [], 0
        for part in sorted_runs():
            rows = part.column("rep").to_numpy()
            if len(rows) < 2:
                continue
            bar = part.column("bar").to_numpy() if by else np.full(len(rows), -1.0)
            x, y, z = _best(rows, part.column("group").to_numpy(), _matrix(part.column("unit")), bar, k, cosine)
            a.append(x)
            b.append(y)
            c.append(z)
            held += len(x)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b, c)], names=["a", "b", "cos"])
                a, b, c, held = [], [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b, c)], names=["a", "b", "cos"])

    return compare


def _lists(pairs: DataFrame, k: int, cosine: float) -> DataFrame:
    """Of pairs (a, b, cos, old) the k best neighbours of each vector, those of place 1 to k, and all pairs at the
    threshold, with bar, the cosine of the last of a full list, and old, 1 if the pair came from the table before."""
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    ranked = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("old").alias("old")).withColumn("place", F.row_number().over(best))
    bar = F.max(F.when(F.col("place") == k, F.col("cos"))).over(Window.partitionBy("a"))
    kept = ranked.filter((F.col("place") <= k) | (F.col("cos") >= cosine - SLACK))
    return checkpoint(kept.select("a", "b", "cos", "old", F.coalesce(bar, F.lit(-1.0)).alias("bar"), "place"))


def neighbour_graph(vectors: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, rounds: int = ROUNDS, seed: int = 0, cosine: float = COSINE, inside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists (a, b, cos, bar) and edges (a, b): NN-descent over vectors (rep, unit, group) of one dimension.

    The first lists come from runs of neighbours in random orders (by signs of random projections). A round
    brings every vector's neighbours and reverse neighbours (and those of `inside`) together and compares
    them with each other, but not those of one group; a pair goes on only if it beats the last of a list.
    Centres with many reverse neighbours are compared in parts of about RUN, dealt anew every round. Edges link
    all pairs that any run had at the threshold, also those that no list has room for. Rounds end when fewer than 1 in 1000 list
    places change, whatever share of the vectors has edges.
    """
    n = partitions(vectors.sparkSession)
    count = vectors.count()
    bits = max(0, min(16, int(math.log2(max(1, count / 64)))))
    code = F.shiftright("code", 16) * 65536 + F.col("code").bitwiseAND((1 << bits) - 1)
    spread = vectors.select("rep", "unit", "group").mapInArrow(lambda b: _hashed(b, tables, seed), "rep long, unit binary, group long, code long, along double")
    spread = spread.withColumn("code", code).repartitionByRange(n, "code", "along").sortWithinPartitions("code", "along")
    seen = _lists(spread.mapInArrow(_compare(k, None, cosine), "a long, b long, cos double").withColumn("old", F.lit(0)), k, cosine)
    for again in range(rounds):
        lists = seen.filter(F.col("place") <= k)
        ways = lists.select("a", "b") if inside is None else lists.select("a", "b").unionByName(inside)
        members = ways.select(F.col("a").alias("centre"), F.col("b").alias("rep")).unionByName(ways.select(F.col("b").alias("centre"), F.col("a").alias("rep"))).distinct()
        bars = lists.groupBy("a").agg(F.max("bar").alias("bar")).withColumnRenamed("a", "rep")
        own = vectors.join(bars, "rep", "left").withColumn("bar", F.coalesce("bar", F.lit(-1.0)))
        # a centre of many members is dealt into parts of about RUN before its members' vectors come to it
        parts = members.groupBy("centre").agg(F.ceil(F.count("*") / RUN).alias("parts"))
        members = members.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(again)), F.col("parts"))).drop("parts")
        met = members.join(own, "rep").repartition(n, "centre", "part").sortWithinPartitions("centre", "part", "rep")
        better = met.mapInArrow(_compare(k, "centre", cosine), "a long, b long, cos double").withColumn("old", F.lit(0))
        seen = _lists(better.unionByName(seen.select("a", "b", "cos", F.lit(1).alias("old"))), k, cosine)
        if seen.filter((F.col("old") == 0) & (F.col("place") <= k)).count() <= count * k / 1000:
            break
    return seen.filter(F.col("place") <= k).drop("place"), seen.filter(F.col("cos") >= cosine - SLACK).select("a", "b")


def _edges(vectors: DataFrame, k: int, tables: int, seed: int, cosine: float) -> DataFrame:
    """Edges (a, b) that link vectors (rep, unit) as all pairs at the threshold do, from each linked one to the
    smallest of its component.

    A list that is full of edges is saturated, and its vector may have more. A vector that is not has all of
    its own, so only saturated vectors can miss edges, with each other. Their lists are enlarged to the
    components that the edges give: the graph is built again over them, with lists of neighbours in other
    components only, until no list is full of edges. Each pass joins every component that is left with
    another one, so their number is halved at least.
    """
    lists, edges = neighbour_graph(vectors.withColumn("group", F.col("rep")), k, tables, seed=seed, cosine=cosine)
    groups = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    inside = None
    for again in itertools.count(1):
        full = lists.filter(F.col("bar") >= cosine - SLACK).select(F.col("a").alias("rep")).distinct()
        left = checkpoint(vectors.join(full, "rep").join(groups, "rep"))
        if left.select("group").distinct().count() < 2:
            return groups.toDF("a", "b")
        ways = lists.select("a", "b") if inside is None else lists.select("a", "b").unionByName(inside)
        inside = checkpoint(ways.join(left.select(F.col("rep").alias("a")), "a").join(left.select(F.col("rep").alias("b")), "b").select("a", "b"))
        lists, edges = neighbour_graph(left, k, tables, seed=seed + 100 * again, cosine=cosine, inside=inside)
        groups = _merged(groups, edges)


def _merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (rep, group) after edges (a, b) between their members; the components are contracted first."""
    ends = edges.select("a", "b").join(groups.toDF("a", "from"), "a").join(groups.toDF("b", "to"), "b")
    moved = connected_components(ends, "from", "to").select(F.col("node").alias("group"), "component")
    return checkpoint(groups.join(moved, "group", "left").select("rep", F.coalesce("component", "group").alias("group")))


def _count(cosine: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each vector within a cell of one component (between its two blocks, if they differ)."""
        for group in _groups(batches, "component", "i", "j"):
            group = group.take(pa.array(np.argsort(group.column("rep").to_numpy(), kind="stable")))
            rows, x = group.column("rep").to_numpy(), _matrix(group.column("unit"))
            cos = x @ x.T
            near = cos >= cosine
            np.fill_diagonal(near, False)
            close = bool((np.abs(cos - cosine) <= 2 * SLACK).any())
            size, block = group.column("n").to_numpy(), group.column("block").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            if i != j:
                near &= block[:, None] != block[None, :]
            label = link(len(rows), lambda k, others: near[k, others])  # noqa: B023
            counts = [pa.array((near @ w).astype(np.int64)) for w in (size, np.ones_like(size))]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows[label]), *counts, pa.array(np.full(len(rows), close))], names=["a", "b", "links", "pairs", "close"])

    return count


def _audit(sample: np.ndarray, ids: np.ndarray, cosine: float):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ sample.T >= cosine
                near &= batch.column(0).to_numpy()[:, None] != ids[None, :]
                total += near.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rep", "true_pairs"])

    return audit


def embedding_links(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, report: dict | None = None) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Equal unit vectors are one class, which has a number of its own and its smallest key. NN-descent gives each class a list of near
    ones; pairs at the threshold are edges. A list that is full of edges is saturated, and its vector may
    have more: so lists are enlarged to the whole component of edges, and the vectors with full lists look for
    neighbours in other components. The vectors of a component are compared in double precision in cells of
    at most two blocks of CELL, without listing pairs. That gives n_links (members of
    linked classes counted, and the other members of the own class) and, where a pair lies within SLACK of the
    threshold, the links of the final components.
    An audit counts the linked classes of a sample of linked vectors by brute force; if less than RECALL of
    them were found, the graph is built again with twice the lists and tables, and the edges of all count.
    If BUILDS graphs fail, all vectors of that length are compared, in the same cells. `report` gets the last recall
    by length, None where no vector that was looked at is linked, so that nothing could be measured.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing, nor do those
    of different lengths with each other. Repeated rows are vectors of their own, and so are different vectors with one
    key. A vector with a null key counts like others; its component is the smallest key that links reach, null if they
    reach none, and kept is null. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = checkpoint(vectors.select(F.col(key).cast("long").alias("vec"), F.col(embedding).cast("array<double>")).mapInArrow(_unit, "vec long, unit binary"))
    classes = rows.filter("unit is not null").groupBy("unit").agg(F.min("vec").alias("key"), F.count("*").alias("n"))
    classes = checkpoint(classes.withColumn("rep", F.monotonically_increasing_id()))
    lengths = [r[0] for r in classes.select(F.octet_length("unit").alias("size")).distinct().collect()]
    groups, whole, wanted = None, [], [(size, NEIGHBOURS, TABLES, 0) for size in lengths]
    result = None
    while wanted:
        for size, k, tables, seed in wanted:
            own = classes.filter(F.octet_length("unit") == size)
            if seed == BUILDS:
                whole.append(size)
                continue
            new = _edges(own.select("rep", "unit"), k, tables, seed, cosine)
            groups = new if groups is None else groups.unionByName(new)
            if seed:  # components of more than one graph
                groups = connected_components(groups).toDF("a", "b")
        result = checkpoint(_linked(groups, classes, cosine, n, whole))
        share = {size: recall(result, classes, size, cosine) for size, _, _, seed in wanted if seed < BUILDS}
        if report is not None:
            report.update(share)
        wanted = [(size, 2 * k, 2 * tables, seed + 1) for size, k, tables, seed in wanted if share.get(size) is not None and share[size] < RECALL]
    if result is None:
        result = spark.createDataFrame([], "rep long, links long, pairs long, component long")
    # the smallest key of a component; classes without a key have none to give
    names = result.join(classes.select("rep", "key"), "rep").groupBy("component").agg(F.min("key").alias("least"))
    found = classes.join(result, "rep", "left").join(names, "component", "left").select("unit", "key", "n", "links", "least")
    return (
        rows.join(found, "unit", "left")
        .withColumn("component_id", F.coalesce("least", "key", "vec"))
        .select(F.col("vec").alias(key), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec") == F.col("component_id")).alias("kept"))
    )


def _linked(groups: DataFrame, classes: DataFrame, cosine: float, n: int, whole: list[int]) -> DataFrame:
    """(rep, links, pairs, component) by exact comparison within components, edges (a, b) from all members to one; all
    of a length in `whole` are compared as one. Components are found anew from the links, unless no pair in them is
    so near the threshold that another order of adding up could tell it apart."""
    groups = groups.toDF("node", "component")
    for size in whole:
        every = classes.filter(F.octet_length("unit") == size).select(F.col("rep").alias("node"))
        groups = groups.join(every, "node", "left_anti").unionByName(every.withColumn("component", F.lit(-size).cast("long")))
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    members = groups.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cells")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    placed = members.select("component", F.col("node").alias("rep"), "block", other.alias("other"))
    placed = placed.select("component", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    counted = (
        placed.join(classes, "rep").repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
        .mapInArrow(_count(cosine), "a long, b long, links long, pairs long, close boolean")
    )
    counted = checkpoint(counted)
    links = counted.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))
    anew = whole or not counted.filter("close").isEmpty()
    comps = (connected_components(counted.select("a", "b")) if anew else groups).select(F.col("node").alias("rep"), "component")
    return links.join(comps, "rep", "left")


def recall(result: DataFrame, classes: DataFrame, size: int, cosine: float = COSINE) -> float | None:
    """The mean share of its linked classes, found by comparison with all, that the result has for a linked vector.

    Vectors are looked through in the order of a hash until AUDIT linked ones are seen, ASKED at most; if these are too
    few, vectors that the result links are asked too. None if no vector asked is linked: then recall is unmeasured.
    """
    own = classes.filter(F.octet_length("unit") == size).select("rep", "unit", F.xxhash64(F.lit("audit"), "rep").alias("at"))
    sample = own.orderBy("at", "rep").limit(ASKED).collect()
    linked, found = _share(result, own, sample, cosine, AUDIT)
    if linked < AUDIT and len(sample) == ASKED:
        others = own.filter(F.col("at") > sample[-1].at).join(result.filter("pairs > 0").select("rep"), "rep", "left_semi")
        more = _share(result, own, others.orderBy("at", "rep").limit(AUDIT - linked).collect(), cosine, AUDIT)
        linked, found = linked + more[0], found + more[1]
    return found / linked if linked else None


def _share(result: DataFrame, own: DataFrame, sample: list, cosine: float, enough: int) -> tuple[int, float]:
    """How many of the sample are linked, until there are enough, and the sum of the shares that the result has of their links."""
    linked, found = 0, 0.0
    for low in range(0, len(sample), ASKED_AT_ONCE):
        part = sample[low : low + ASKED_AT_ONCE]
        ids = np.array([r.rep for r in part], np.int64)
        units = np.frombuffer(b"".join(bytes(r.unit) for r in part), np.float64).reshape(len(part), -1)
        true = own.select("rep", "unit").mapInArrow(_audit(units, ids, cosine), "rep long, true_pairs long").groupBy("rep").agg(F.sum("true_pairs").alias("true_pairs"))
        both = true.filter("true_pairs > 0").join(result, "rep", "left").agg(F.count("*"), F.sum(F.coalesce("pairs", F.lit(0)) / F.col("true_pairs"))).first()
        linked, found = linked + both[0], found + (both[1] or 0.0)
        if linked >= enough:
            break
    return linked, found
