"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch as stars around each component's least node."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        label, x, y = np.arange(len(nodes)), index[: len(a)], index[len(a) :]
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        star = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[star]), pa.array(nodes[label[star]])], ["u", "v"])


def components(links: DataFrame, files: int = 0) -> DataFrame:
    """(node, component) of every node of links (u, v: long), component being its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) with joins and minima by node, each round a
    written table of at most so many files (if given), until no link changes; no node's links are gathered in one place.
    """
    edges = materialize(links.filter("u <> v").mapInArrow(_contracted, "u long, v long").distinct(), files)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before_edges, edges = edges, materialize(small, files)
        discard(before_edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
