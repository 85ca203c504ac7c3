"""Balanced panels: sentinels, ranges, listwise deletion, excess returns, macro construction, interactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import log_positive

# Codes for missing numbers in the raw files.
SENTINELS = (-99.99, -999.0, -999.99)


def recode_sentinels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing codes become null; columns are numbers already."""
    return df.withColumns({c: F.when(~F.col(c).isin(*SENTINELS), F.col(c)) for c in columns})


def month_start(yyyymm: Column) -> Column:
    return F.to_date(F.concat(F.trim(yyyymm.cast("string")), F.lit("01")), "yyyyMMdd")


def percent_to_decimal(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) / 100.0 for c in columns})


def listwise(df: DataFrame, value: str = "ret", drop: list[str] = (), keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Keeps months in which every asset (but those dropped first) has a value. Long form."""
    df = df.filter(~F.col("asset").isin(*drop)) if drop else df
    assets = df.groupBy(*keys).agg(F.countDistinct("asset").alias("_n"))
    months = df.groupBy(*keys, "month").agg(F.count(value).alias("_k"))
    full = months.join(assets, list(keys)).filter("_k = _n").select(*keys, "month")
    return df.join(full, [*keys, "month"], "left_semi")


def common_range(*frames: DataFrame) -> list[DataFrame]:
    """Each frame from the latest start to the earliest end of all."""
    edges = [f.agg(F.min("month").alias("lo"), F.max("month").alias("hi")) for f in frames]
    both = reduce(DataFrame.union, edges).agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return [f.crossJoin(F.broadcast(both)).filter(F.col("month").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi") for f in frames]  # one row


def join_factors(factors: DataFrame, momentum: DataFrame) -> DataFrame:
    return factors.join(momentum, "month")


def excess_returns(returns: DataFrame, factors: DataFrame, rate: str = "RF") -> DataFrame:
    """ret minus the month's rate; months without a rate go."""
    rates = factors.select("month", F.col(rate).alias("_rf"))
    return returns.join(rates, "month").withColumn("ret", F.col("ret") - F.col("_rf")).drop("_rf")


def restricted(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of df in the given months; fails when run if a month has none."""
    kept = df.join(months.select("month").distinct(), "month", "left_semi")
    lost = months.select("month").distinct().join(df.select("month"), "month", "left_anti")
    check = lost.agg(F.count(F.lit(1)).alias("_lost"))
    return kept.crossJoin(F.broadcast(check)).filter(F.when(F.col("_lost") > 0, F.raise_error(F.lit("months are missing"))).otherwise(F.lit(True))).drop("_lost")


def stabilised(df: DataFrame, rows: int = 30, keys: tuple[str, ...] = ("universe", "asset")) -> DataFrame:
    """Drops the first rows of each asset, counted before rows with missing values go."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("month"))
    return df.withColumn("_row", rank).filter(F.col("_row") > rows).drop("_row")


def complete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def macro_features(df: DataFrame) -> DataFrame:
    """Predictors from the macro columns Index, D12, E12, b/m, ntis, svar, tbl, infl, BAA, AAA, lty, one row a month."""
    before = F.lag("Index").over(W.orderBy("month"))  # a few hundred months
    return df.select(
        "month",
        F.col("`b/m`").alias("BM"),
        F.col("ntis").alias("NTIS"),
        F.col("svar").alias("SVAR"),
        F.col("tbl").alias("TBL"),
        F.col("infl").alias("CPI"),
        (log_positive(F.col("D12")) - log_positive(before)).alias("DY"),
        (log_positive(F.col("E12")) - log_positive(F.col("Index"))).alias("EP"),
        (F.col("BAA") - F.col("AAA")).alias("DFY"),
        (F.col("lty") - F.col("tbl")).alias("TMS"),
    )


def interactions(common: list[str], own: list[str]) -> list[Column]:
    """Products of every common with every own predictor, common-major, named common_x_own."""
    return [(F.col(f"`{c}`") * F.col(f"`{o}`")).alias(f"{c}_x_{o}") for c in common for o in own]


def assembled(df: DataFrame, common: list[str], own: list[str], keep: list[str]) -> DataFrame:
    """f: intercept, common, own, interactions, as one array; names: the matching list (predictor_names)."""
    parts = [F.lit(1.0), *(F.col(f"`{c}`") for c in [*common, *own]), *interactions(common, own)]
    return df.select(*keep, F.array(*parts).alias("f"))


def predictor_names(common: list[str], own: list[str]) -> list[str]:
    return ["intercept", *common, *own, *(f"{c}_x_{o}" for c in common for o in own)]


def predictor_group(name: Column, common: list[str]) -> Column:
    return F.when(name == "intercept", "intercept").when(F.contains(name, F.lit("_x_")), "interaction").when(name.isin(*common), "common").otherwise("own")
