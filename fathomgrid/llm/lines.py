"""Line dedup by frequency within a site, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, salted

#: Salts of the shuffled join that stands in where the boilerplate is too large to broadcast.
SALTS = 64


def _mark(line: Column) -> Column:
    """128 bits of a line, as text: arrays of text are compared by hashing."""
    return _name(F.xxhash64(line), F.xxhash64(F.lit(1), line))


def _name(a: Column, b: Column) -> Column:
    return F.concat(F.hex(a), F.lit("."), F.hex(b))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.1, min_pages: int = 2, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Drops lines found on more than ratio of their host's pages, and on min_pages of them at least (by default: a line
    that only one page has isn't boilerplate, however few pages its host has).

    Returns (row: the input columns as a struct, kept_text, n_lines, n_removed). A page counts once for each of its
    lines, a row is a page, a line is what stands between line feeds, and blank lines stay. Rows without host are a host of
    their own; a null text has 0 lines and stays null, an empty one has 1 (blank) line. Counts are summed before and
    after one shuffle by host and line. A host's boilerplate is an array of at most (mean lines of a page) / ratio
    hashes; all arrays are broadcast if their counted size allows, else joined by host and salt.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    host = F.concat(F.when(F.col(f"row.`{host_col}`").isNull(), "n").otherwise("h"), F.coalesce(F.col(f"row.`{host_col}`").cast("string"), F.lit("")))
    pages = rows.select(host.alias("host"), F.split(F.col(f"row.`{text_col}`"), "\n", -1).alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).filter(F.trim("line") != "")
    counts = found.groupBy("host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    frequent = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    lists = materialize(frequent.groupBy("host").agg(F.collect_list(_name(F.col("a"), F.col("b"))).alias("marks")))
    weight = lists.agg(F.coalesce(F.sum(F.size("marks") * 64 + 64), F.lit(0)).alias("n")).first()["n"]
    rows = rows.withColumn("host", host)
    if weight <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", salted(f"row.`{id_col}`", SALTS)).join(spread, ["host", "salt"], "left")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    # a page's own marks among the host's, found by hashing both; then each line is looked up in those few
    here = F.array_intersect(F.transform(lines, _mark), F.col("marks"))
    out = joined.select("row", lines.alias("lines"), F.when(F.col("marks").isNotNull(), here).alias("marks"))
    kept = F.when(F.coalesce(F.size("marks") <= 0, F.lit(True)), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("marks"), _mark(x))))
    out = out.select("row", "lines", kept.alias("kept"))
    return out.select(
        "row",
        F.when(F.col("lines").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )
