"""Approximate nearest neighbours by largest inner product: adaptive dimension scan.

Vectors are lengthened by one coordinate that gives all the same norm, so the largest
inner product is the smallest distance, and turned by a random rotation. They lie in
inverted lists around centroids that k-means in numpy fits on at most ``sample``
rows; every row is indexed. A list is dealt out in blocks of bounded size, whatever
holds it, and a query meets the blocks of the lists it probes in many tasks.

Inside a block the rotated coordinates are read in column blocks. After each, the
partial distance of a candidate, scaled up to all coordinates, is tested against the
bound: beyond it by more than the error that the number of coordinates allows
(``1 + slack / sqrt(read)``), the candidate is abandoned. The bound of a query is its
k-th best distance in the nearest list, searched first. Survivors are scored exactly,
in double precision on the original vectors.

How many lists are probed is measured: for ``trials`` of the queries all rows are
scored by brute force (in blocks of rows), and the number of lists is taken that holds
the share ``recall`` of their true neighbours, with the rank of lists by distance.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components or have another length than most take no part, nor do rows without id. A
query is one row per id (the smallest vector, if ids repeat); rows of its own id are
no candidates; other repeated rows are candidates of their own. Ties go to the smaller
id. Extra columns are ignored. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, written

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Search:
    k: int = 20
    sample: int = 20_000
    per_list: int = 1000
    most_lists: int = 2048
    trials: int = 100
    recall: float = 0.97
    columns: int = 16
    few: float = 0.1
    slack: float = 2.1
    block: int = 2000
    queries: int = 250
    seed: int = 5


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int, float]:
    """The rows that take part (``vec_id, v``), their number, length and largest norm."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), square.alias("square"))
    good = good.where(F.col("vec_id").isNotNull() & finite & (F.col("square") > 0))
    # One row per length of vector; the most frequent length wins, then the longer.
    lengths = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("rows"), F.max("square").alias("square"))
    most = lengths.orderBy(F.desc("rows"), F.desc("width")).limit(1).collect()
    if not most:
        return good.select("vec_id", "v"), 0, 0, 0.0
    width = most[0].width
    return good.where(F.size("v") == width).select("vec_id", "v"), most[0].rows, width, float(np.sqrt(most[0].square))


@dataclass
class Index:
    """What every task needs: rotation, norm and centroids, of bounded size."""

    rotation: np.ndarray
    norm: float
    centroids: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.column_stack((x, last)) @ self.rotation

    def turned_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q)))) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To the centroids, up to a constant per row."""
        return (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T


def fitted(good: DataFrame, count: int, width: int, norm: float, search: Search) -> Index:
    """Centroids by k-means on the rows that come first in the order of a hash."""
    rows = good.orderBy(F.xxhash64("vec_id", F.lit(search.seed)), "vec_id", "v").limit(search.sample).select("v").toArrow()
    dice = np.random.default_rng(search.seed)
    rotation = np.linalg.qr(dice.standard_normal((width + 1, width + 1)))[0]
    index = Index(rotation, norm * (1 + 1e-9), np.empty((0, width + 1)))
    x = index.turned(_matrix(rows.column(0).combine_chunks(), width))
    lists = int(np.clip(count // search.per_list, 1, min(search.most_lists, len(x))))
    index.centroids = x[dice.choice(len(x), lists, replace=False)]
    for _ in range(8):
        own = index.distances(x).argmin(axis=1)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=lists)
        index.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], index.centroids)
    return index


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def listed(good: DataFrame, index: Index) -> DataFrame:
    """Every row with the list of its nearest centroid."""
    width = len(index.rotation) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = index.distances(index.turned(_matrix(batch.column(1), width))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["vec_id", "v", "list"])

    return good.mapInArrow(run, "vec_id long, v array<double>, list int")


def probes(lists: DataFrame, queries: list[tuple[int, np.ndarray]], index: Index, search: Search) -> int:
    """Lists to probe, measured against brute force for some queries."""
    width = len(index.rotation) - 1
    ids = np.array([q for q, _ in queries])
    q = np.stack([v for _, v in queries])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, place = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = q @ _matrix(batch.column(1), width).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            for n in range(len(q)):
                at = _best(scores[n], own, search.k)
                at = at[np.isfinite(scores[n][at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), n)), pa.array(own[at]), pa.array(scores[n][at]), pa.array(place[at], pa.int32())],
                    names=["n", "vec_id", "score", "list"],
                )

    found = lists.mapInArrow(run, "n long, vec_id long, score double, list int")
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k).select("n", "list").toArrow()
    n, place = (true.column(i).to_numpy() for i in (0, 1))
    if not len(n):
        return len(index.centroids)
    rank = index.distances(index.turned_queries(q)).argsort(axis=1).argsort(axis=1)[n, place]
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(search.recall * len(rank))) - 1)]) + 1


def probing(queries: DataFrame, index: Index, first: int, last: int) -> DataFrame:
    """One row for every query and list, from the ``first``-nearest list to before the ``last``."""
    width = len(index.rotation) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                q = index.turned_queries(_matrix(part.column(1), width))
                near = index.distances(q).argsort(axis=1, kind="stable")[:, first:last]
                rows = part.take(pa.array(np.repeat(np.arange(len(q)), near.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(near.ravel(), pa.int32())], names=[*part.schema.names, "list"]
                )

    return queries.mapInArrow(run, "query_id long, q array<double>, bound double, list int")


def scan(turned: np.ndarray, turned_q: np.ndarray, bounds: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place of query, place of candidate) that no test abandons.

    ``turned`` holds candidates by column, ``turned_q`` queries by row. While many
    pairs are left, a column block is read for all of them as one product, without the
    candidates that every query has abandoned; then pair by pair.
    """
    total, count = turned.shape
    places = np.arange(count)
    partial = np.zeros((len(turned_q), count))
    alive = np.ones(partial.shape, dtype=bool)
    start = 0

    def limit(stop: int) -> np.ndarray:
        if stop == total:
            return bounds * (1 + 1e-9) + 1e-9
        return bounds * (1 + search.slack / np.sqrt(stop)) ** 2 * stop / total

    while start < total and alive.size and alive.mean() > search.few:
        stop = min(start + search.columns, total)
        own, asked = turned[start:stop], turned_q[:, start:stop]
        partial += (asked**2).sum(axis=1)[:, None] + (own**2).sum(axis=0) - 2 * asked @ own
        alive &= partial <= limit(stop)[:, None]
        left = alive.any(axis=0)
        if left.mean() < 0.8:
            places, turned, partial, alive = places[left], turned[:, left], partial[:, left], alive[:, left]
        start = stop
    q, x = np.nonzero(alive)
    square = partial[q, x]
    while start < total and len(q):
        stop = min(start + search.columns, total)
        square = square + ((turned[start:stop, x] - turned_q[q, start:stop].T) ** 2).sum(axis=0)
        near = square <= limit(stop)[q]
        q, x, square, start = q[near], x[near], square[near], stop
    return q, places[x]


def block_best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, pairs, k: int):
    """Of the pairs the k best of every query: places of queries, of candidates, exact scores."""
    at, to = pairs
    other = q_ids[at] != ids[to]
    at, to = at[other], to[other]
    scores = np.empty(len(at))
    for start in range(0, len(at), 1 << 16):
        part = slice(start, start + (1 << 16))
        scores[part] = (q[at[part]] * x[to[part]]).sum(axis=1)
    order = np.lexsort((ids[to], -scores, at))
    at, to, scores = at[order], to[order], scores[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    best = rank < k
    return at[best], to[best], scores[best]


def met(lists: DataFrame, sizes: DataFrame, probed: DataFrame, index: Index, search: Search) -> DataFrame:
    """The best of every block for every query that probes its list."""
    width = len(index.rotation) - 1
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    some = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    # A list that many queries probe is met in several tasks, each with a share of them.
    asked = written(probed, "probed")
    shares = asked.groupBy("list").agg(F.ceil(F.count("*") / search.queries).cast("int").alias("shares"))
    plan = written(sizes.join(shares, "list"), "probed-lists")
    held = lists.join(plan, "list").select("list", block.alias("block"), some.alias("share"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    share = F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")
    asking = asked.join(plan, "list").select("list", every.alias("block"), share.alias("share"), "query_id", "q", "bound")
    keys = ("list", "block", "share")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("v").combine_chunks(), width)
            ids = left.column("vec_id").to_numpy()
            turned = np.ascontiguousarray(index.turned(x).T)
            q = _matrix(right.column("q").combine_chunks(), width)
            q_ids = right.column("query_id").to_numpy()
            bounds = pc.fill_null(right.column("bound"), np.inf).to_numpy()
            at, to, scores = block_best(x, ids, q, q_ids, scan(turned, index.turned_queries(q), bounds, search), search.k)
            out.append((q_ids[at], ids[to], scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score"])

    return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(meet, RESULT)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, search: Search = Search()) -> DataFrame:
    """The ``search.k`` nearest found for every row that ``is_query`` chooses by its ``vec_id``.

    Returns ``query_id, rank, vec_id, score``.
    """
    importable(vectors.sparkSession)
    good, count, width, norm = usable(vectors)
    queries = good.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(search.trials).collect() if count else []
    if not tried:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fitted(good, count, width, norm, search)
    lists = written(listed(good, index), "lists")
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / search.block).cast("int").alias("blocks"))
    sizes = written(sizes, "list-sizes")
    last = probes(lists, [(r.query_id, np.array(r.q)) for r in tried], index, search)

    unbound = queries.withColumn("bound", F.lit(None).cast("double"))
    first = written(met(lists, sizes, probing(unbound, index, 0, 1), index, search), "first-lists")
    worst = _top(first, search.k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("held"))
    # The squared distance that belongs to the k-th best inner product.
    square = F.aggregate("q", F.lit(0.0), lambda total, x: total + x * x)
    bound = square + F.lit(index.norm**2) - 2 * F.col("least")
    bounded = queries.join(worst, "query_id", "left").select(
        "query_id", "q", F.when(F.col("held") >= search.k, bound).alias("bound")
    )
    rest = met(lists, sizes, probing(bounded, index, 1, max(last, 1)), index, search)
    return _top(first.unionByName(rest), search.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)
