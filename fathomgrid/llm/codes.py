"""Compressed codes of vectors: a codebook for each part position, its entries searched by a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize

#: Entries of a tree's leaf; rows that a task searches at a time.
LEAF, ROWS = 6, 8_192
#: Squared distances must stay below this, so that no sum wraps.
MOST = 1 << 62
#: Relative width by which roots are rounded away from pruning.
SLACK = 2.0**-48
#: Salts of the join with label sums where these are too many to broadcast.
SALTS = 16


class Tree:
    """Vantage-point tree over the entries (integer vectors) of one part position.

    A node holds a vantage entry and two halves of the other entries, nearer and farther; each half knows the least and
    the greatest distance of its entries from the vantage entry, the first rounded down, the second up.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grown(np.arange(len(entries)))

    def _grown(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return (at,)
        centre = self.entries[at].mean(axis=0)
        top = at[np.argmax(((self.entries[at] - centre) ** 2).sum(axis=1))]  # an outer entry parts the others best
        rest = at[at != top]
        far = ((self.entries[rest] - self.entries[top]) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        return (top, *((self._grown(rest[o]), roots(far[o[0]])[0], roots(far[o[-1]])[1]) for o in (order[:half], order[half:])))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; of equally near ones, the lowest index.

        Each point first goes down its nearer halves, then visits what may hold an entry as near as the best one
        found (the bound is not strict: a tie may have a lower index). Distances that decide are integers.
        """
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        self._descend(self.root, points, np.arange(len(points)), best, index)
        self._visit(self.root, points, np.arange(len(points)), best, index)
        return index, best

    def _compared(self, entry: int, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        far = ((points[rows] - self.entries[entry]) ** 2).sum(axis=1)
        won = (far < best[rows]) | (far == best[rows]) & (entry < index[rows])
        best[rows[won]], index[rows[won]] = far[won], entry
        return far

    def _descend(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 1:
            for entry in node[0]:
                self._compared(entry, points, rows, best, index)
            return
        top, (near, _, edge), (away, begin, _) = node
        far = np.sqrt(self._compared(top, points, rows, best, index).astype(float))
        inner = far <= (edge + begin) / 2
        self._descend(near, points, rows[inner], best, index)
        self._descend(away, points, rows[~inner], best, index)

    def _visit(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 1:
            for entry in node[0]:
                self._compared(entry, points, rows, best, index)
            return
        top, *halves = node
        low, high = roots(self._compared(top, points, rows, best, index))
        for half, least, most in halves:
            bound = np.maximum(low - most, least - high)  # no entry of the half is nearer, as distances are a metric
            open_ = bound * (1 - SLACK) <= roots(best[rows])[1]
            self._visit(half, points, rows[open_], best, index)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of integers, rounded down and up by more than any step of their computation errs."""
    root = np.sqrt(squares.astype(float))
    return root * (1 - SLACK), root * (1 + SLACK)


def integers(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors as (vector, part, position). Raises where squared distances could wrap."""
    if not len(column):
        return np.empty((0, parts, 0), np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(len(column), parts, -1)
    most = float(np.abs(values).max(initial=0))
    if 4 * most * most * max(values.shape[2] * parts, 1) >= MOST:
        raise ValueError(f"a component of {most / scale:g} is too large: squared distances would leave 64 bits")
    return values.astype(np.int64)


def _searched(books: np.ndarray, vectors: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry."""
    found = [tree.nearest(vectors[:, i]) for i, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def usable(vectors: DataFrame, vector_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector has no null or non-finite component and the length that most vectors have, and that length.

    The length must be a positive multiple of parts; of equally frequent lengths the greatest counts.
    """
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = vectors.filter(vector.isNotNull()).filter(fine)
    lengths = whole.groupBy(F.size(vector).alias("size")).count().filter((F.col("size") > 0) & (F.col("size") % parts == 0))
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return whole.filter(F.size(vector) == size) if size else whole.limit(0), size


def moved(vectors: DataFrame, books: np.ndarray, scale: int, vector_col: str) -> np.ndarray:
    """The codebooks after one round: each used entry becomes the floored mean of the parts that are nearest to it.

    Each task sends a row of sums for each part and entry that it has used; what reaches the driver is as large as the
    codebooks, whatever the table.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                points = integers(batch.column(0).slice(lo, ROWS), scale, parts)
                index = _searched(books, points, trees)[0] + np.arange(parts) * entries
                np.add.at(sums, index.ravel(), points.reshape(-1, width))
                counts += np.bincount(index.ravel(), minlength=parts * entries)
        used = np.flatnonzero(counts)
        at = np.repeat(used, width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].ravel()), pa.array(counts[at])], ["slot", "place", "total", "n"])

    found = vectors.select(vector_col).mapInArrow(run, "slot long, place long, total long, n long")
    out = books.reshape(parts * entries, width).copy()
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for row in found.groupBy("slot", "place").agg(big("total"), big("n")).collect():
        out[row["slot"], row["place"]] = int(row["total"]) // int(row["n"])
    return out.reshape(books.shape)


def initial(vectors: DataFrame, entries: int, parts: int, scale: int, id_col: str, vector_col: str) -> np.ndarray:
    """Codebooks of the vectors with the smallest ids (of equal ids, the smaller vectors; null ids last)."""
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    return np.ascontiguousarray(integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), scale, parts).transpose(1, 0, 2))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors, and the codebooks (part, entry, position): (id, label, code, error, label_error).

    A component x becomes floor(scale * x), a vector parts equal consecutive parts. A part position's codebook starts
    as that part of the entries smallest ids; each round gives every part to its nearest entry (squared distance, ties to
    the lower index) and makes used entries the floored means of their parts. code has two hexadecimal digits for each
    part, error is the vector's squared distance from what its code stands for, label_error the sum of errors of equal
    labels, null labels together. Each round reads the table once; no task holds more than codebooks and a batch.

    Rows whose vector is null, holds a null or non-finite component, or hasn't the length that most have (a multiple of
    parts) are dropped; fewer rows than entries make smaller codebooks; repeated rows each get a code; a null id is kept.
    An empty table has no codes and no entries. Components so large that distances would leave 64 bits raise an error.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    vectors, size = usable(vectors.select(id_col, label_col, vector_col), vector_col, parts)
    books = initial(vectors, entries, parts, scale, id_col, vector_col) if size else np.empty((parts, 0, 0), np.int64)
    for _ in range(rounds if size else 0):
        books = moved(vectors, books, scale, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(max(books.shape[1], 1))])
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                points = integers(batch.column(2).slice(lo, ROWS), scale, parts)
                index, far = _searched(books, points, trees)
                names = pa.array(["".join(row) for row in digits[index].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, ROWS), batch.column(1).slice(lo, ROWS), names, pa.array(far.sum(axis=1))], ["id", "label", "code", "error"])

    coded = materialize(vectors.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    found, salt = checked(sums, 32), F.lit(0)
    if found is sums:
        salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
        found = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    else:
        found = found.withColumn("salt", F.lit(0))
    left, right = coded.withColumn("salt", salt).alias("l"), found.alias("r")
    joined = left.join(right, (F.col("l.salt") == F.col("r.salt")) & F.col("l.label").eqNullSafe(F.col("r.label")))
    return joined.select(F.col("id").alias(id_col), F.col("l.label").alias(label_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
