"""A corpus pipeline of five stages; each takes and (but for the last) returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import contamination, jaccard, language, lines
from fathomgrid.llm import queries as Q
from fathomgrid.llm.common import bounded, checked, discard, gathered, materialize, table

#: SQL can't express the first stage; tests hold each stage against a plain computation.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: null texts, those without a letter or with a score below 0.35."""
    docs = gathered(bounded(docs))
    return language.accepted(docs, language.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the texts; n_chars follows."""
    found = lines.drop_boilerplate(gathered(bounded(docs)))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Rows of one id are one document and stay or go together; rows without id stay.
    """
    docs = gathered(bounded(docs))
    found = materialize(jaccard.similar(docs))
    return docs.join(checked(found.filter("doc_id <> component_id").select("doc_id").distinct(), 8), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go.

    Each row is judged by its own text, so that rows without id or with one id don't decide for each other.
    """
    docs = gathered(bounded(docs))
    key = [F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")]
    found = contamination.decontaminate(docs.select(F.struct(*key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = materialize(found.filter(contamination.judged()).select("doc_id.*").distinct())
    left, right = docs.alias("l"), checked(bad, 16).alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.i")) & (F.xxhash64("l.text") == F.col("r.h"))
    return left.join(right, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left; null texts and ids are documents like others."""
    return Q.packed(gathered(bounded(docs)))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            before, docs = docs, materialize(out)
            if i:
                discard(before)
    return out
