"""Descriptive statistics of panels: moments, autocorrelation, covariance and correlation, volatility bands, ECDF, KDE."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order, scan

U = ("universe",)


def asset_statistics(df: DataFrame, value: str = "ret") -> DataFrame:
    """Mean and sd in per cent, annual Sharpe ratio, AR(1) coefficient of demeaned values, by asset."""
    own = W.partitionBy(*U, "asset")
    d = df.withColumn("_c", F.col(value) - F.avg(value).over(own)).withColumn("_b", F.lag("_c").over(own.orderBy("month")))
    sd = F.stddev_samp(value)
    return d.groupBy(*U, "asset").agg(
        (100 * F.avg(value)).alias("mean_pct"),
        (100 * sd).alias("sd_pct"),
        (F.try_divide(F.avg(value), sd) * math.sqrt(12)).alias("sharpe"),
        F.try_divide(F.sum(F.col("_c") * F.col("_b")), F.sum(F.col("_c") * F.col("_c"))).alias("ar1"),
    )


def statistic_ranges(stats: DataFrame) -> DataFrame:
    """Min, median and max over assets of each statistic."""
    long = stats.unpivot(list(U), ["mean_pct", "sd_pct", "sharpe", "ar1"], "statistic", "x")
    return long.groupBy(*U, "statistic").agg(F.min("x").alias("lo"), F.median("x").alias("mid"), F.max("x").alias("hi"))


def covariance(df: DataFrame, value: str = "ret") -> DataFrame:
    """Sample covariance of assets over months, long (i, j, cov): the outer product of each month's vector, its upper
    triangle summed within tasks before the shuffle and mirrored after it."""
    months = df.groupBy(*U, "month").agg(F.array_sort(F.collect_list(F.struct("asset", F.col(value).alias("x")))).alias("v"))
    left = months.select(*U, F.posexplode("v").alias("at", "a"), "v")
    pairs = left.select(*U, "a", F.explode(F.slice("v", F.col("at") + 1, F.size("v"))).alias("b"))
    upper = pairs.groupBy(*U, F.col("a.asset").alias("i"), F.col("b.asset").alias("j")).agg(F.covar_samp("a.x", "b.x").alias("cov"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select(*U, "cov", F.explode(sides).alias("p")).select(*U, "p.i", "p.j", "cov")


def positive_definite(cov: DataFrame) -> bool:
    """Whether a long covariance of one universe (assets by assets: small) is positive definite."""
    import numpy as np

    rows = cov.select("i", "j", "cov").toPandas()
    m = rows.pivot(index="i", columns="j", values="cov").to_numpy(float)
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return False
    return True


def correlations(df: DataFrame, columns: list[str], by: tuple[str, ...] = U) -> DataFrame:
    """Pearson correlation of each pair of columns (a < b), long; constant columns give null and are left out."""
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spread = {c: F.max(c) > F.min(c) for c in columns}
    ok = [F.struct(p.getField("a").alias("a"), p.getField("b").alias("b"), F.when(spread[a] & spread[b], p.getField("corr")).alias("corr")) for p, (a, b) in zip(parts, [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]])]
    out = df.groupBy(*by).agg(F.array(*ok).alias("p")).select(*by, F.explode("p").alias("p"))
    return out.select(*by, "p.a", "p.b", "p.corr").filter("corr is not null")


def correlation_summary(corr: DataFrame, limit: float = 0.9, by: tuple[str, ...] = U) -> DataFrame:
    x = F.abs("corr")
    return corr.groupBy(*by).agg(F.count_if(x > limit).alias("n_high"), F.median(x).alias("median_abs"), F.percentile(x, 0.99).alias("p99_abs"), F.count(F.lit(1)).alias("n_pairs"))


def ranked_correlations(corr: DataFrame, by: tuple[str, ...] = U) -> DataFrame:
    return corr.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round(F.abs("corr"), 9)), "a", "b")))


def market(df: DataFrame, value: str = "ret") -> DataFrame:
    """Equal-weight mean of the assets by month."""
    return df.groupBy(*U, "month").agg(F.avg(value).alias("mean_ret"))


def cumulative_log(df: DataFrame, value: str, at: str = "month", by: tuple[str, ...] = U) -> DataFrame:
    return scan.running_sum(df, F.log1p(value), by, at, "cum_log")


def rolling_volatility(df: DataFrame, months: int = 36, value: str = "ret") -> DataFrame:
    """Least and largest annualised trailing volatility over assets, by month with full windows."""
    w = W.partitionBy(*U, "asset").orderBy("month").rowsBetween(1 - months, 0)
    v = df.withColumn("_v", F.when(F.count(value).over(w) == months, F.stddev_samp(value).over(w) * math.sqrt(12)))
    return v.filter("_v is not null").groupBy(*U, "month").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def predictor_rms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Root mean square of each predictor over months, by asset."""
    return df.groupBy(*U, "asset").agg(*(F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}") for c in columns))


def prior_scale(df: DataFrame, columns: list[str], value: str = "r_next") -> DataFrame:
    """trace of the predictors' pooled covariance and the population variance of returns."""
    trace = F.lit(0.0)
    for c in columns:
        trace = trace + F.var_samp(c)
    return df.groupBy(*U).agg(trace.alias("trace_c"), F.var_pop(value).alias("var_r"))


def ecdf(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    return df.withColumn("ecdf", F.cume_dist().over(W.partitionBy(*by).orderBy(value)))


def share_below(df: DataFrame, value: str, limit: float, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) < limit).cast("double")).alias("share_below"))


def quantiles(df: DataFrame, value: str, by: tuple[str, ...], levels: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return order.quantiles(df, value, by, {f"p{round(100 * x):02d}": x for x in levels})


def density(df: DataFrame, value: str, by: tuple[str, ...], points: int = 64, factor: float = 0.2) -> DataFrame:
    """Gaussian kernel density on a grid of points over the range; bandwidth factor * sd. The grid meets all rows once."""
    edges = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), (factor * F.stddev_samp(value)).alias("_h"))
    grid = edges.select(*by, "_h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), "_lo", "_hi").withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (points - 1))
    z = (F.col("x") - F.col(value)) / F.col("_h")
    return df.select(*by, value).join(F.broadcast(grid), list(by)).groupBy(*by, "k", "x").agg(F.avg(F.exp(-0.5 * z * z) / (F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def top_by_size(df: DataFrame, value: str, n: int, by: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The n rows of each group with the largest |value|, ties by the given columns."""
    w = W.partitionBy(*by).orderBy(F.desc(F.abs(value)), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def extremes(df: DataFrame, value: str, n: int, by: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """The n least and n most of each group, told apart by end."""
    up, down = (W.partitionBy(*by).orderBy(o, *ties) for o in (F.asc(value), F.desc(value)))
    lo = df.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= n).withColumn("end", F.lit("least"))
    return lo.unionByName(df.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= n).withColumn("end", F.lit("most")))


def group_means(df: DataFrame, value: str, group: Column, by: tuple[str, ...]) -> DataFrame:
    """Mean of value by predictor group, and over all."""
    out = df.groupBy(*by, group.alias("grp")).agg(F.avg(value).alias("mean"))
    return out.unionByName(df.groupBy(*by).agg(F.avg(value).alias("mean")).withColumn("grp", F.lit("all")))


def setting_pairs(settings: DataFrame, name: str = "setting") -> DataFrame:
    """All pairs a < b of a small table of settings."""
    a = settings.select(F.col(name).alias("a")).distinct()
    return a.crossJoin(F.broadcast(a.select(F.col("a").alias("b")))).filter("a < b")
