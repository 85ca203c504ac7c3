"""Approximate nearest neighbours by collision counting over single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, salted

#: Vectors in a block of the index and queries in a block of searches: together they bound a task's memory.
BLOCK, SEARCHES = 1 << 13, 1 << 15
#: By how much a step of virtual rehashing widens the windows.
WIDEN = 1.02
#: Steps below the query before's last one at which the next query begins.
BEHIND = 6


def cosines(q: np.ndarray, x: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Cosine of q with each row, summed in the same order for every row, so that equal vectors get equal values."""
    norms = np.sqrt(np.sum(x * x, axis=1)) if norms is None else norms
    return np.sum(x * q, axis=1) / (np.sqrt(np.sum(q * q)) * norms)


class Index:
    """Sorted projections of unit vectors. All m functions have one projection each and no fixed buckets."""

    def __init__(self, unit: np.ndarray, projections: np.ndarray):
        values = (unit @ projections).T
        self.m, self.n = values.shape
        self.order = np.argsort(values, axis=1, kind="stable").ravel()
        # projections lie in [-1, 1]: one array holds them all, each four further on than the one before
        self.shift = 4.0 * np.arange(self.m)
        self.sorted = (np.sort(values, axis=1) + self.shift[:, None]).ravel()
        self.guess = 0

    def bounds(self, point: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of this half width around the query (its projections) begin and end."""
        at = point + self.shift
        return np.searchsorted(self.sorted, at - half, side="left"), np.searchsorted(self.sorted, at + half, side="right")

    def collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([self.order[a:b] for a, b in zip(lo.tolist(), hi.tolist())]), minlength=self.n)

    def candidates(self, point: np.ndarray, want: int, threshold: float, width: float, least: int) -> np.ndarray:
        """The vectors that collide with the query in threshold of the windows, the narrowest with least such vectors.

        Virtual rehashing widens all windows by WIDEN at a time and counts what they add. It begins BEHIND steps before
        where the query before ended and goes back if that is too wide already, so that the result is the query's own.
        """
        need = int(np.ceil(threshold * self.m))
        least = min(self.n, max(least, want))
        half = lambda k: min(3.0, width / 2 * WIDEN**k)  # noqa: E731  from 2 on a window holds everything
        k = max(0, self.guess - BEHIND)
        while True:
            lo, hi = self.bounds(point, half(k))
            count = self.collisions(lo, hi)
            if k == 0 or np.count_nonzero(count >= need) < least:
                break
            k = max(0, k - BEHIND)
        while np.count_nonzero(count >= need) < least:
            k += 1
            left, right = self.bounds(point, half(k))
            count += self.collisions(np.concatenate([left, hi]), np.concatenate([lo, right]))
            lo, hi = left, right
        self.guess = k
        return np.flatnonzero(count >= need)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = 96, threshold: float = 0.6, width: float = 0.1, share: float = 0.2, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors by cosine of each query, its own row excepted: (query_id, rank, vec_id, score).

    queries has ids and vectors like vectors. Equal vectors are one entry that keeps its k + 1 least ids (all that ties
    to smaller ids can need). Entries are parted into blocks of bounded size, each with sorted arrays of its
    projections; every block of queries meets every block of the index, expands its windows and verifies exactly, in
    double precision, what collides in threshold of the projections, at least share of the block; then the best k of
    all blocks stay. Work grows with queries times vectors, each task's with one block and SEARCHES queries. A query gets all other vectors if they are fewer than k. Vectors that are null, of another length
    than most, zero, or holding null or non-finite components take no part; ids that are null neither; repeated rows
    are one. Of several vectors under one id the best counts, for queries as for neighbours, which are listed once.
    Other columns are dropped.
    """
    good = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    shape = F.col(vector_col).cast("array<double>").alias("v")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), shape).filter(good & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("q"), shape).filter(good & F.col("q").isNotNull()).distinct()
    entries = materialize(_entries(base, k + 1))
    sizes = entries.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return asked.select(F.col("q").alias("query_id"), F.lit(0).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dim = sizes["n"]
    entries, asked = entries.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    blocks = max(1, -(-entries.count() // BLOCK))
    groups = max(1, -(-asked.count() // SEARCHES))
    directions = np.random.default_rng(seed).standard_normal((dim, projections))
    directions /= np.sqrt((directions**2).sum(axis=0))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries of one group in one block of the index."""
        x = np.array(left.column("v").combine_chunks().flatten()).reshape(-1, dim)
        ids = left.column("ids").to_pylist()
        norms = np.sqrt(np.sum(x * x, axis=1))
        index = Index(x / norms[:, None], directions)
        least = int(np.ceil(share * len(x)))
        points = np.array(right.column("v").combine_chunks().flatten()).reshape(-1, dim)
        out: list[tuple[int, int, float]] = []
        for q, point in zip(right.column("q").to_pylist(), points):
            at = index.candidates((point / np.sqrt(np.sum(point * point))) @ directions, k + 1, threshold, width, least)
            score = cosines(point, x[at], norms[at])
            best: dict[int, float] = {}
            top = 4 * (k + 1)
            while len(best) < k:  # more than the first few only where ids have several vectors
                edge = np.partition(score, len(at) - top)[len(at) - top] if top < len(at) else -np.inf
                some = np.flatnonzero(score >= edge)
                best = {}
                for s, i in sorted((-score[a], i) for a in some.tolist() for i in ids[at[a]] if i != q):
                    best.setdefault(i, -s)
                    if len(best) == k:
                        break
                if top >= len(at):
                    break
                top *= 8
            out += [(q, i, float(s)) for i, s in best.items()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["q", "id", "score"])

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["q", "id", "score"])
        return search(left, right)

    number = F.xxhash64(F.col("ids")[0])
    index = entries.select("v", "ids", F.pmod(number, F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    search_for = asked.select("q", "v", salted("q", groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    found = index.groupBy("b", "g").cogroup(search_for.groupBy("b", "g")).applyInArrow(pairs, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _entries(base: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their least ids, first within tasks, so that many copies are never gathered."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).to_pylist()
            held: dict[tuple, list[int]] = {}
            for i, v in zip(ids.tolist(), vectors):
                held.setdefault(tuple(v), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array([list(v) for v in held], pa.list_(pa.float64())), pa.array([sorted(set(x))[:keep] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    few = base.mapInArrow(least, "v array<double>, ids array<long>")
    # -0.0 equals 0.0 as a key, in Python and here
    return few.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
