"""Best-fit packing of documents into token sequences by linear grouping."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, materialize, numbered, rank_within, small_files
from .tokens import encoder


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids followed by id 0, cut every size ids: (id, piece, start, length, ids_crc32[, ids binary]).

    A null or empty text is the one piece of id 0. Null and repeated ids are documents like others; other columns are
    dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for i, text in enumerate(as_bytes(batch.column(1))):
                ids = enc.ids(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for column, value in zip(rows, (i, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, k) for r, k in zip(rows[1:], kinds))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def grouped(counts: np.ndarray, small: int, groups: int) -> list[tuple[int, int, int]]:
    """Equal-cardinality groups of the lengths above small, longest first: (rounded size, first rank, end rank)."""
    lengths = np.arange(len(counts) - 1, small, -1)
    cum = np.cumsum(counts[lengths])
    total = int(cum[-1]) if len(cum) else 0
    out = []
    edges = np.unique(np.linspace(0, total, groups + 1).astype(np.int64))
    for lo, hi in zip(edges[:-1], edges[1:]):
        out.append((int(lengths[np.searchsorted(cum, lo, side="right")]), int(lo), int(hi)))
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Column generation for few sizes: patterns (pieces of each size) and how often each is used, rounded down."""
    s, need = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)  # columns are patterns
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            fits = s <= c
            value = np.where(fits, best[np.maximum(c - s, 0)] + price, -1.0)
            j = int(value.argmax())
            if value[j] > best[c - 1]:
                best[c], chosen[c] = value[j], j
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, c = np.zeros(len(s)), capacity
        while c > 0:
            if chosen[c] < 0 or best[c] == best[c - 1]:
                c -= 1
            else:
                pattern[chosen[c]] += 1
                c -= s[chosen[c]]
        enter, level = inverse @ pattern, inverse @ need
        ratio = np.where(enter > 1e-9, level / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    level = np.linalg.inv(basis) @ need
    return [(basis[:, j].astype(int), int(np.floor(x + 1e-6))) for j, x in enumerate(level) if x >= 1 - 1e-6]


def filled(bins: np.ndarray, items: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best fit of small items, longest first, into bins given by how many have each free space.

    Whole runs of equal items and equal bins move at once, so that the work depends on the number of distinct lengths,
    not on the corpus. Rows of the plan: item length, first and end rank of the items, bin class (its free space at
    first, or capacity + 1 for new bins), rank of the first bin in that class, offset in the bin; then new bins.
    """
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    for free in np.flatnonzero(bins):
        if free:
            runs[free].append((int(free), 0, int(bins[free])))
    nonempty = np.array([bool(r) for r in runs])
    plan, new = [], 0
    for length in np.flatnonzero(items)[::-1]:
        length, left, rank = int(length), int(items[length]), 0
        while left:
            free = length + int(nonempty[length:].argmax())
            if not nonempty[free]:
                count = -(-left // (capacity // length))
                runs[capacity].append((capacity + 1, new, new + count))
                new, free, nonempty[capacity] = new + count, capacity, True
            kind, lo, hi = runs[free].pop()
            take = min(left, hi - lo)
            plan.append((length, rank, rank + take, kind, lo, capacity - free))
            if lo + take < hi:
                runs[free].append((kind, lo + take, hi))
            nonempty[free] = bool(runs[free])
            rest = free - length
            if rest:
                runs[rest].append((kind, lo, lo + take))
                nonempty[rest] = True
            left, rank = left - take, rank + take
    return np.array(plan, np.int64).reshape(-1, 6), new


def _ranges(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A plan's rows, whose number depends on the distinct lengths and not on the corpus, for a broadcast join."""
    columns = zip(*rows) if rows else [()] * len(names.split())
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names.split())))


def _by_length(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Rows for each value of a column from 0 to size (at most size + 1 rows reach the driver)."""
    counts = np.zeros(size + 1, np.int64)
    for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r[0]] = r[1]
    return counts


def pack(items: DataFrame, size: int = 2048, groups: int = 48, small: int = 896) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length): as few sequences as it can, gapless from offset 0.

    Lengths above small are parted into groups of equal cardinality and rounded up to the longest of their group;
    column generation finds how often each configuration of the few sizes is used; documents take their groups' places
    by rank. What is left over and the small ones then go best-fit into the true free space. Only counts by length
    (at most size of them) reach the driver; the plans made of them are joined by length and range of ranks. Pieces of
    full size are sequences of their own and need no rank. An empty table stays empty; null ids and repeated rows are
    pieces like others.
    """
    spark = items.sparkSession
    by = [c for c in items.columns if c != "length"]
    inner = _by_length(items, "length", size)
    files = small_files(32 * int(inner.sum()))
    inner[size] = 0
    ranked = materialize(rank_within(items.filter(F.col("length") < size), "length", by, "_rank", inner), files)
    large = grouped(inner, small, groups)
    patterns = configurations([g[0] for g in large], [g[2] - g[1] for g in large], size) if large else []
    # places of each group: as many ranks as its patterns hold, from the group's longest on
    slots, sequences = [], 0
    used = np.zeros(len(large), np.int64)
    for pattern, times in patterns:
        for g in np.flatnonzero(pattern):
            for _ in range(pattern[g]):
                take = min(times, large[g][2] - large[g][1] - int(used[g]))
                if take > 0:
                    slots.append((large[g][1] + int(used[g]), take, sequences))
                    used[g] += take
        sequences += times
    above = np.concatenate([[0], np.cumsum(inner[::-1])])[:-1][::-1]  # items longer than each length
    places = []
    for first, take, sequence in slots:
        for length in np.flatnonzero((inner > 0) & (above < first + take) & (above + inner > first)):
            base = int(above[length])
            lo, hi = max(first, base), min(first + take, base + int(inner[length]))
            places.append((int(length), lo - base, hi - base, sequence + base - first))
    here = _ranges(spark, places, "_l _lo _hi _base")
    inside = (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(here, inside, "left").withColumn("_seq", F.col("_base") + F.col("_rank")).drop("_l", "_lo", "_hi", "_base", "_rank")
    grown = W.partitionBy("_seq").orderBy(F.desc("length"), *by)  # a few rows each
    fixed = materialize(placed.filter(F.col("_seq").isNotNull()).withColumn("offset", F.sum("length").over(grown) - F.col("length")), files)
    seqs = fixed.groupBy("_seq").agg((F.lit(size) - F.sum("length")).cast("long").alias("_free"))
    free = _by_length(seqs, "_free", size)
    rest = placed.filter(F.col("_seq").isNull()).drop("_seq")
    left = _by_length(rest, "length", size)
    rest = rank_within(rest, "length", by, "_rank", left)
    plan, new = filled(free, left, size)
    base = np.concatenate([[0], np.cumsum(free)])  # numbers of sequences by free space; new ones follow
    fills = [(length, lo, hi, int(base[kind]) + at - lo, offset) for length, lo, hi, kind, at, offset in plan.tolist()]
    here = _ranges(spark, fills, "_l _lo _hi _base offset")
    seqs = rank_within(seqs, "_free", ["_seq"], "_rank", free)
    number = numbered(base, "_free") + F.col("_rank")
    out = [*items.columns, "sequence_id", "offset"]
    a = fixed.join(seqs.select("_seq", number.alias("sequence_id")), "_seq").select(out)
    b = rest.join(here, inside).withColumn("sequence_id", F.col("_base") + F.col("_rank")).select(out)
    c = items.filter(F.col("length") == size).withColumn("sequence_id", F.lit(int(base[-1]) + new) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(out)
    every = a.unionByName(b).unionByName(c)
    return every.coalesce(files) if files else every
