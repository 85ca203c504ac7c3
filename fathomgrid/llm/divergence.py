"""How far the sources of a language stand apart in their use of words, by inclusion-exclusion over supports."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, checked, materialize
from .textops import LOWER

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WORD = re.compile(TERM.encode())  # on UTF-8, whose other bytes are all above 7F
#: Terms that a task holds at a time; bytes of a text whose words aren't listed all at once.
HELD, LONG = 300_000, 1 << 22
#: Prices are parts of SCALE, plus one; each term counts PRIOR occurrences more than it has.
SCALE, PRIOR = 1_000_000_000, 5
#: Salts of the join of histograms with groups where the groups are too many to broadcast.
SALTS = 64
#: Sources of a term that one task pairs with as many others; terms of more sources are dealt out by blocks.
BLOCK = 1_024


def price(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; 0 in a language without terms."""
    share = f"cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(19,0)) div cast({total} + {PRIOR} * {terms} as decimal(19,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({share}) ELSE 0 END").cast("long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each (lang, source), sent whenever HELD terms have gathered."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> pa.RecordBatch:
        sizes = [len(n) for n, _ in held.values()]
        names = [np.repeat(np.array([g[i] for g in held], object), sizes) for i in (0, 1)]
        terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
        counts = [pa.array([x for both in held.values() for x in both[i].values()], pa.int64()) for i in (0, 1)]
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(n, pa.string()) for n in names), terms, *counts], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            text = text.translate(LOWER)
            if len(text) <= LONG:
                words = WORD.findall(text)
                n.update(words)
                docs.update(dict.fromkeys(words).keys())  # in the order of n: their values are sent side by side
            else:  # never as a list of all its words
                own = Counter(m[0] for m in WORD.finditer(text))
                n.update(own)
                docs.update(own.keys())
            size += len(n) - before
            if size >= HELD:
                yield sent()
                size = 0
    if held:
        yield sent()


def postings(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, of_lang) of each term in at least least documents of its language: occurrences in the group, in the language.

    Occurrences and documents are counted in the same pass, first in the task that reads the texts; their sums go
    through two narrow shuffles.
    """
    found = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    groups = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")  # a row for each source
    every = groups.withColumn("in_docs", F.sum("docs").over(same)).withColumn("of_lang", F.sum("n").over(same))
    return every.filter(F.col("in_docs") >= least).select("lang", "source", "term", "n", "of_lang")


def _paired(held: DataFrame) -> DataFrame:
    """Of every two groups that share terms: what pricing the shared ones one side at a time gets wrong, summed.

    A term's groups are joined with each other; a term of more than BLOCK groups is dealt out by pairs of blocks.
    """
    blocks = held.groupBy("lang", "term").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("blocks"))
    held = held.join(blocks, ["lang", "term"]).withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = held.select("lang", "term", F.col("own").alias("i"), other.alias("j"), F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = held.select("lang", "term", F.col("own").alias("j"), other.alias("i"), F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    both = a.join(b, ["lang", "term", "i", "j"]).filter("a < b")
    wrong = F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")
    return both.groupBy("lang", "a", "b").agg(F.sum(wrong).alias("value"))


def _one_sided(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Of every two groups: each one's terms priced against the other's price of an absent term, and the absent terms.

    A group is its histogram: how many terms have which price. A row without count stands for the group itself.
    """
    prices = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    own = groups.select("lang", "source", F.col("zero").alias("za"), "kept", "held")
    none = F.lit(None).cast("long")
    rows = prices.select("lang", F.col("source").alias("a"), "p", "terms", none.alias("za"), none.alias("kept"), none.alias("held"))
    rows = rows.unionByName(own.select("lang", F.col("source").alias("a"), none.alias("p"), none.alias("terms"), "za", "kept", "held"))
    others = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    found = checked(others, 128)
    if found is others:  # too many groups to send around: each language's are dealt out by salt
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(SALTS)))
        found = others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = rows.join(found, [c for c in ("lang", "salt") if c in found.columns]).filter("a <> b")
    value = F.expr("CASE WHEN p IS NULL THEN (if(a < b, kept, 0L) - held) * abs(za - zb) ELSE terms * abs(p - zb) END")
    return both.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(value).alias("value"))


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Distances between the sources of a language, and each source's own words: (lang, source, part, item, value, rank).

    A language keeps the terms that at least least of its documents have. A group (language and source) and a language
    price each kept term by its share of their occurrences, smoothed and scaled (price). Part `pair` has for every other
    source of the language the sum, over all kept terms, of the differences of prices; part `term` the terms that a group
    prices above its language, with the difference, to rank ranks. Values descend, ties go by item.

    Terms that neither group has differ by a constant, terms that one has are priced from its histogram of prices
    against the other's price of an absent term, and only terms of both are compared one by one, by joining postings: the
    sum over all terms is never spelled out. All arithmetic is on integers.

    A row is a document, repeated ones too. Null text, lang and source are read as empty; a group without terms has the
    prices of absent terms; in a language without kept terms all pairs have distance 0. Other columns don't matter.
    """
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept = materialize(postings(docs, least))
    terms = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("of_lang"))
    sizes = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(terms, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["kept", "of_lang", "held", "n"])
    groups = materialize(groups.withColumn("absent", zero).withColumn("zero", price("absent", "n", "kept")).drop("absent"), 1)
    named = groups.select("lang", "source", "zero", "kept", F.col("n").alias("total"), F.col("of_lang").alias("of_all"))
    held = kept.join(checked(named, 128), ["lang", "source"])
    held = held.withColumn("p", price("n", "total", "kept")).withColumn("q", price("of_lang", "of_all", "kept"))

    sums = _one_sided(held, groups).unionByName(_paired(held)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", "value", ends.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    own = held.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
