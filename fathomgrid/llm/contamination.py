"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_bytes, discard, materialize, slices
from .textops import ALNUM, inside, windows, words

#: Bits of the filter of benchmark fingerprints that documents are tried against before the join; a full one only lets more through.
FILTER_BITS = 1 << 27
#: What a fingerprint row of a matched place takes, its items apart.
MATCH_BYTES = 400
KEY = ["m", "print", "back", "ahead"]
FINGERPRINT = "m int, print long, place long, back array<long>, ahead array<long>"
Prints = tuple[int, np.ndarray, np.ndarray]


def winnowed(hashes: np.ndarray, bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Places of the k-grams that are the least of some n - k + 1 consecutive ones of the same text (all ties)."""
    grams = windows(hashes, k)
    if not len(grams):
        return np.empty(0, np.int64)
    grams[~inside(bounds, k, len(grams))] = np.iinfo(np.uint64).max
    run = n - k + 1
    full = len(hashes) - n + 1
    if full <= 0:
        return np.empty(0, np.int64)
    least = grams[:full].copy()
    for t in range(1, run):
        np.minimum(least, grams[t : t + full], out=least)
    ok = inside(bounds, n, full)
    chosen = np.zeros(len(grams), bool)
    for t in range(run):
        chosen[t : t + full] |= (grams[t : t + full] == least) & ok
    return np.flatnonzero(chosen)


def of_items(hashes: np.ndarray, bounds: np.ndarray, n: int, k: int) -> Iterator[Prints]:
    """(0, places, fingerprints) of the winnowed k-grams, and (m, place, hash) of each item of m < n words as a whole."""
    size = np.diff(bounds)
    at = winnowed(hashes, bounds, k, n)
    yield 0, at, windows(hashes, k)[at]
    for m in np.unique(size[(size > 0) & (size < n)]).tolist():
        at = bounds[:-1][size == m]
        yield m, at, windows(hashes, m)[at]


def of_documents(hashes: np.ndarray, bounds: np.ndarray, n: int, k: int, short: list[int], known: np.ndarray) -> Iterator[Prints]:
    """The same of documents, which may hold an item of m words anywhere; only those that the filter knows."""
    for m in (0, *short):
        grams = windows(hashes, m or k)
        at = np.flatnonzero(inside(bounds, m, len(grams))) if m else winnowed(hashes, bounds, k, n)
        bit = grams[at] & np.uint64(64 * len(known) - 1)
        at = at[(known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        yield m, at, grams[at]


def _runs(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, step: int) -> pa.ListArray:
    """From each place so many hashes, forwards or backwards."""
    ends = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[np.repeat(first, size) + step * within].view(np.int64)))


def _rows(hashes: np.ndarray, bounds: np.ndarray, prints: Prints, n: int, k: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The text of each fingerprint, and its columns: place in the text, n - k words before (backwards), n from it on."""
    m, at, grams = prints
    of = np.searchsorted(bounds, at, side="right") - 1
    back = np.zeros(len(at), np.int64) if m else np.minimum(n - k, at - bounds[of])
    ahead = np.full(len(at), m) if m else np.minimum(n, bounds[of + 1] - at)
    columns = [pa.array(np.full(len(at), m), pa.int32()), pa.array(grams.view(np.int64)), pa.array(at - bounds[of], pa.int64()), _runs(hashes, at - 1, back, -1), _runs(hashes, at, ahead, 1)]
    return of, columns


def _sketch(prints: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the fingerprints set. Its size is fixed, whatever the benchmark's."""
    bit = F.col("print").bitwiseAND(FILTER_BITS - 1)
    word = prints.select(F.shiftrightunsigned(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(print & 63 AS int))").alias("bits"))
    found = word.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _item_prints(benchmark: DataFrame, n: int, k: int) -> DataFrame:
    """(item, fingerprint columns) of distinct (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_bytes(batch.column(1))
            for lo, hi in slices(rows):
                hashes, bounds = words([t.translate(ALNUM) for t in rows[lo:hi]])
                for prints in of_items(hashes, bounds, n, k):
                    of, columns = _rows(hashes, bounds, prints, n, k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + lo)), *columns], ["item", "m", "print", "place", "back", "ahead"])

    return benchmark.mapInArrow(run, f"item string, {FINGERPRINT}")


def _document_prints(kind: str, n: int, k: int, short: list[int], sketch: Broadcast) -> tuple[Callable, str]:
    """For each row (row, id, text): one with its words counted and no fingerprint, and one for each fingerprint known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_words", "m", "print", "place", "back", "ahead"]
        for batch in batches:
            rows = as_bytes(batch.column(2))
            for lo, hi in slices(rows):
                hashes, bounds = words([t.translate(ALNUM) for t in rows[lo:hi]])
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), *none], names)
                for prints in of_documents(hashes, bounds, n, k, short, sketch.value):
                    of, columns = _rows(hashes, bounds, prints, n, k)
                    if len(of):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + lo)), pa.nulls(len(of), batch.column(1).type), pa.nulls(len(of), pa.int64()), *columns], names)

    return run, f"row long, id {kind}, n_words long, {FINGERPRINT}"


def _common(a: str, b: str) -> Column:
    """How many elements two arrays have in common from the first on."""
    differ = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    return F.expr(f"CASE WHEN {differ} = 0 THEN size({a}) ELSE {differ} - 1 END")


def _matched(marks: DataFrame, prints: DataFrame, n: int) -> DataFrame:
    """(fingerprint and its surroundings, before, after, items): how far the longest shared span reaches to both sides.

    Equal places of documents are joined once, however many copies there are. All spans of a place contain it, so the
    widest reach to each side is their union.
    """
    there = prints.groupBy(*KEY).agg(F.collect_set("item").alias("items"))
    there = there.select("m", "print", F.col("back").alias("_back"), F.col("ahead").alias("_ahead"), "items")
    pairs = marks.select(*KEY).distinct().join(there, ["m", "print"])
    pairs = pairs.withColumns({"before": _common("back", "_back"), "after": _common("ahead", "_ahead")})
    long = pairs.filter((F.col("before") + F.col("after")) >= F.when(F.col("m") == 0, n).otherwise(F.col("m")))
    return long.groupBy(*KEY).agg(F.max("before").alias("before"), F.max("after").alias("after"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _united(spans: DataFrame) -> DataFrame:
    """(row, n_hit, spans): unions of the spans (row, first, end) of each row."""
    own = W.partitionBy("row").orderBy("first", "end")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    apart = spans.withColumn("_new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    island = apart.withColumn("_at", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0))).groupBy("row", "_at")
    merged = island.agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return merged.groupBy("row").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _broadcast_if_small(matched: DataFrame) -> DataFrame:
    size = matched.agg(F.sum(F.lit(MATCH_BYTES) + F.octet_length(F.array_join("items", ", ")))).first()[0] or 0
    return F.broadcast(matched) if size <= BROADCAST_BYTES else matched


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, k: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark windows of n words in documents: (id, n_words, n_hit, items, spans).

    items are the ids (as strings, sorted) of items with a window in the document, spans the half-open word ranges hit.
    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A window is n consecutive
    item words, or all words of a shorter item.

    The least k-gram hash of each run of n - k + 1 consecutive k-grams is a fingerprint, of items and documents alike, so
    that every shared span of n words has a common one; an item of m < n words is its one m-gram. Fingerprints are
    joined, with the words around them, and hits extended by these: a window reaches n - k words beyond its fingerprint
    at most. Documents are read once, whatever the benchmark's size; a filter of fixed size keeps most of their
    fingerprints from the join and loses none that matches.

    A null or empty text has no words; an item without words never occurs; an empty benchmark hits nothing; repeated
    rows of documents give a row each, repeated items count once. Other columns are dropped. Two tables in the shared
    folder back the result.
    """
    spark: SparkSession = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    prints = materialize(_item_prints(items, n, k).drop("place").distinct())
    short = sorted(r["m"] for r in prints.filter("m > 0").select("m").distinct().collect())  # fewer than n
    sketch = spark.sparkContext.broadcast(_sketch(prints))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = materialize(rows.mapInArrow(*_document_prints(docs.schema[id_col].dataType.simpleString(), n, k, short, sketch)))
    sketch.unpersist()
    marks = found.filter("m is not null")
    matched = materialize(_matched(marks, prints, n))
    discard(prints)
    hits = marks.join(_broadcast_if_small(matched), KEY)
    spans = _united(hits.select("row", (F.col("place") - F.col("before")).alias("first"), (F.col("place") + F.col("after")).alias("end")).distinct())
    names = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<first:bigint,end:bigint>>")
    out = found.filter("m is null").select("row", F.col("id").alias(id_col), "n_words").join(spans.join(names, "row", "left"), "row", "left")
    return out.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def judged() -> Column:
    """Whether a row of decontaminate() is contaminated: a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
