"""Raw text files with sections: five factors, momentum, macro, portfolios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import clean_number
from fathomgrid.operators.panel import month_start, recode_sentinels

# The portfolio sorts by universe, and what marks the monthly sections.
UNIVERSES = {
    "size_bm_25": "25_Portfolios_BM_5x5.csv",
    "size_op_25": "25_Portfolios_OP_5x5.csv",
    "size_inv_25": "25_Portfolios_INV_5x5.csv",
    "size_bm_100": "100_Portfolios_BM_10x10.csv",
}
FACTORS_HEADER, MOMENTUM_HEADER, PORTFOLIO_MARKER = ",Mkt-RF", ",Mom", "Average Value Weighted Returns -- Monthly"


def section(spark: SparkSession, path: str, starts: Column, header_after: int = 0) -> tuple[list[str], DataFrame]:
    """Column names and rows (cells: array of text) of the section whose header is header_after lines below the first
    line that starts is true of (a condition on the column line). The section ends at the first blank line or the file's end.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    head = lines.filter(starts).agg((F.min("n") + header_after).alias("h"))
    rows = lines.join(F.broadcast(head), F.col("n") >= F.col("h"))  # one row
    stop = rows.filter((F.trim("line") == "") & (F.col("n") > F.col("h"))).agg(F.min("n").alias("stop"))
    rows = rows.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    header = rows.filter("n = h").select("line").first()
    if header is None:
        raise ValueError(f"{path} has no such section")
    names = [c.strip() for c in header["line"].split(",")][1:]
    return names, rows.filter("n > h").select(F.split("line", ",").alias("cells"))


def monthly(names: list[str], rows: DataFrame) -> DataFrame:
    """Months and numbers of a section; percent becomes decimal after missing codes became null."""
    rows = rows.filter(F.trim(F.col("cells")[0]).rlike("^[0-9]{6}$"))
    df = rows.select(month_start(F.col("cells")[0]).alias("month"), *(clean_number(F.get("cells", F.lit(i + 1))).alias(n) for i, n in enumerate(names)))
    df = recode_sentinels(df, names)
    return df.withColumns({n: F.col(f"`{n}`") / 100.0 for n in names})


def load_five_factors(spark: SparkSession, path: str) -> DataFrame:
    """month and Mkt-RF, SMB, HML, RMW, CMA, RF; annual rows after the blank line are left out."""
    return monthly(*section(spark, path, F.startswith("line", F.lit(FACTORS_HEADER))))


def load_momentum(spark: SparkSession, path: str) -> DataFrame:
    return monthly(*section(spark, path, F.startswith("line", F.lit(MOMENTUM_HEADER)))).withColumnRenamed("Mom", "UMD")


def load_factors(spark: SparkSession, five: str, momentum: str) -> DataFrame:
    """All factors, RF among them (drop it for predictors)."""
    return load_five_factors(spark, five).join(load_momentum(spark, momentum), "month")


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with quoted thousands and literal NaN: month and all other columns as doubles."""
    raw = spark.read.csv(path, header=True, quote='"')
    others = [c for c in raw.columns if c.strip() != "yyyymm"]
    date = next(c for c in raw.columns if c.strip() == "yyyymm")
    return raw.select(month_start(F.col(f"`{date}`")).alias("month"), *(clean_number(F.col(f"`{c}`")).alias(c.strip()) for c in others))


def load_portfolios(spark: SparkSession, universe: str, folder: str) -> DataFrame:
    """(universe, asset, month, ret) of a registered universe's value-weighted monthly section."""
    if universe not in UNIVERSES:
        raise ValueError(f"{universe!r} isn't one of {', '.join(UNIVERSES)}")
    names, rows = section(spark, f"{folder}/{UNIVERSES[universe]}", F.contains("line", F.lit(PORTFOLIO_MARKER)), 1)
    wide = monthly(names, rows)
    return wide.unpivot(["month"], names, "asset", "ret").select(F.lit(universe).alias("universe"), "asset", "month", "ret")


def load_all_portfolios(spark: SparkSession, folder: str, universes: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [load_portfolios(spark, u, folder) for u in universes or list(UNIVERSES)[:3]])
