"""Forecast accuracy, long-short portfolios and their statistics, over long forecasts (universe, asset, t, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import normal_cdf

U = ("universe",)


def sse(a: str, b: str) -> Column:
    return F.sum(F.pow(F.col(a) - F.col(b), 2))


def oos_r2(df: DataFrame, by: tuple[str, ...] = U) -> DataFrame:
    """1 - SSE / SSE of the benchmark over all rows of each group; null where the latter is 0."""
    return df.groupBy(*by).agg((1.0 - F.try_divide(sse("realised", "predicted"), F.when(sse("realised", "benchmark") > 0, sse("realised", "benchmark")))).alias("r2"))


def r2_by_asset(df: DataFrame) -> DataFrame:
    return oos_r2(df, (*U, "asset"))


def r2_summary(df: DataFrame) -> DataFrame:
    return r2_by_asset(df).groupBy(*U).agg(F.median("r2").alias("median_r2"), F.count_if(F.col("r2") > 0).alias("n_positive"))


def weights(df: DataFrame, by: tuple[str, ...] = (*U, "t")) -> DataFrame:
    """w: cross-sectionally demeaned forecasts over their gross; 0 where the gross is negligible."""
    cross = W.partitionBy(*by)
    d = df.withColumn("_d", F.col("predicted") - F.avg("predicted").over(cross)).withColumn("_g", F.sum(F.abs("_d")).over(cross)).withColumn("_p", F.sum(F.abs("predicted")).over(cross))
    return d.withColumn("w", F.when(F.col("_g") > 1e-12 * F.greatest("_p", F.lit(1e-300)), F.col("_d") / F.col("_g")).otherwise(0.0)).drop("_d", "_g", "_p")


def pooled_weights(df: DataFrame) -> DataFrame:
    """w over the assets of all universes of a month; 0 only where the gross is."""
    cross = W.partitionBy("t")
    d = df.withColumn("_d", F.col("predicted") - F.avg("predicted").over(cross)).withColumn("_g", F.sum(F.abs("_d")).over(cross))
    return d.withColumn("w", F.when(F.col("_g") > 0, F.col("_d") / F.col("_g")).otherwise(0.0)).drop("_d", "_g")


def portfolio(df: DataFrame, by: tuple[str, ...] = (*U, "t")) -> DataFrame:
    """q: return of the weighted portfolio of each month."""
    return df.groupBy(*by).agg(F.sum(F.col("w") * F.col("realised")).alias("q"))


def gross_exposure(df: DataFrame) -> DataFrame:
    return df.groupBy(*U, "t").agg(F.sum(F.abs("w")).alias("g")).groupBy(*U).agg(F.avg("g").alias("mean_gross"), F.min("g").alias("min_gross"))


def _sharpe(x: str, annual: bool = True) -> Column:
    ok = F.stddev_samp(x) > 1e-12 * F.max(F.abs(x))
    return F.when(ok, F.avg(x) / F.when(ok, F.stddev_samp(x)) * math.sqrt(12.0 if annual else 1.0))


def sharpe(df: DataFrame, by: tuple[str, ...] = U, value: str = "q", annual: bool = True) -> DataFrame:
    return df.groupBy(*by).agg(_sharpe(value, annual).alias("sharpe"))


def certainty_equivalent(df: DataFrame, gamma: float = 3.0, by: tuple[str, ...] = U, value: str = "q", annual: bool = True) -> DataFrame:
    return df.groupBy(*by).agg(((F.avg(value) - gamma / 2 * F.var_samp(value)) * (12.0 if annual else 1.0)).alias("ce"))


def scores(df: DataFrame, by: tuple[str, ...] = U, gamma: float = 3.0, value: str = "q") -> DataFrame:
    """Annual Sharpe ratio and certainty equivalent in one pass."""
    return df.groupBy(*by).agg(_sharpe(value).alias("sharpe"), (12.0 * (F.avg(value) - gamma / 2 * F.var_samp(value))).alias("ce"))


def long_run_variance(df: DataFrame, value: str, by: tuple[str, ...] = U, lags: int | None = None) -> DataFrame:
    """Newey-West: (n, mean, lags, lrv) of each group's series over t, Bartlett weights, floor(4 (n/100)^(2/9)) lags."""
    w = W.partitionBy(*by)
    d = df.withColumn("_n", F.count(value).over(w)).withColumn("_c", F.col(value) - F.avg(value).over(w))
    d = d.withColumn("_l", F.lit(lags).cast("int") if lags is not None else F.floor(4 * F.pow(F.col("_n") / 100.0, F.lit(2.0 / 9))).cast("int"))
    d = d.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("t")))
    ahead = d.select(*by, F.explode(F.sequence(F.lit(0), F.col("_l"))).alias("_k"), (F.col("_i") + F.col("_k")).alias("_i"), F.col("_c").alias("_e"))
    g = d.join(ahead, [*by, "_i"]).groupBy(*by, "_k").agg((F.sum(F.col("_c") * F.col("_e")) / F.first("_n")).alias("g"), F.first("_l").alias("_l"), F.first("_n").alias("n"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("_k") / (F.col("_l") + 1.0)))
    lrv = g.groupBy(*by).agg(F.max("n").alias("n"), F.max("_l").alias("lags"), F.greatest(F.sum(weight * F.col("g")), F.lit(0.0)).alias("lrv"))
    return lrv.join(df.groupBy(*by).agg(F.avg(value).alias("mean")), list(by))


def _tested(df: DataFrame, by: tuple[str, ...], two_sided: bool) -> DataFrame:
    t = long_run_variance(df, "d", by).withColumn("stat", F.when(F.col("lrv") > 0, F.col("mean") / F.sqrt(F.when(F.col("lrv") > 0, F.col("lrv")) / F.col("n"))))
    p = 2.0 * (1.0 - normal_cdf(F.abs("stat"))) if two_sided else 1.0 - normal_cdf(F.col("stat"))
    return t.withColumn("p", p)


def diebold_mariano(df: DataFrame, a: str, b: str, by: tuple[str, ...] = U) -> DataFrame:
    """Equal accuracy of forecasts in columns a and b: (mean, n, lags, stat, p two-sided, better if p < .05)."""
    loss = df.groupBy(*by, "t").agg((F.avg(F.pow(F.col("realised") - F.col(a), 2)) - F.avg(F.pow(F.col("realised") - F.col(b), 2))).alias("d"))
    out = _tested(loss, by, True)
    return out.withColumn("better", F.when(F.col("p") < 0.05, F.when(F.col("stat") < 0, a).otherwise(b)).otherwise("neither"))


def clark_west(df: DataFrame, by: tuple[str, ...] = U) -> DataFrame:
    """Nested models: the model against the benchmark, one-sided."""
    f = F.pow(F.col("realised") - F.col("benchmark"), 2) - F.pow(F.col("realised") - F.col("predicted"), 2) + F.pow(F.col("benchmark") - F.col("predicted"), 2)
    return _tested(df.groupBy(*by, "t").agg(F.avg(f).alias("d")), by, False)


def loss_decomposition(df: DataFrame, by: tuple[str, ...] = U) -> DataFrame:
    """Four shares of the benchmark's SSE that add up to -R2: variance and covariance, common and across assets."""
    e, d = F.col("realised") - F.col("benchmark"), F.col("predicted") - F.col("benchmark")
    x = df.select(*by, "asset", "t", e.alias("e"), d.alias("d"))
    cross = W.partitionBy(*by, "t")
    x = x.withColumns({"eb": F.avg("e").over(cross), "db": F.avg("d").over(cross)})
    s = F.sum(F.col("e") * F.col("e"))
    et, dt = F.col("e") - F.col("eb"), F.col("d") - F.col("db")
    return x.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("db") * F.col("db")), s).alias("var_common"),
        F.try_divide(F.sum(dt * dt), s).alias("var_cross"),
        F.try_divide(-2.0 * F.sum(F.col("eb") * F.col("db")), s).alias("cov_common"),
        F.try_divide(-2.0 * F.sum(et * dt), s).alias("cov_cross"),
    )


def volatility_ratio(df: DataFrame, by: tuple[str, ...] = U) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.stddev_pop("predicted"), F.stddev_pop("realised")).alias("vol_ratio"))


def stacked(df: DataFrame) -> DataFrame:
    """Mean of the universes' portfolio returns by month."""
    return df.groupBy("t").agg(F.avg("q").alias("q"))


def same_months(df: DataFrame) -> DataFrame:
    """Months of some universe that another lacks; pooling needs this to be empty."""
    every = df.select("universe").distinct().crossJoin(F.broadcast(df.select("t").distinct()))  # universes x months
    return every.exceptAll(df.select("universe", "t").distinct())


def cross_sort(df: DataFrame, gamma: float = 3.0) -> DataFrame:
    """Pooled, stacked and within-universe portfolios: (portfolio, sharpe, ce), and which universe is best.

    One pass over the forecasts: both weights stand on each row, and a month's first universe carries the two others.
    """
    rows = pooled_weights(weights(df).withColumnRenamed("w", "_w"))
    q = rows.groupBy("universe", "t").agg(F.sum(F.col("_w") * F.col("realised")).alias("q"), F.sum(F.col("w") * F.col("realised")).alias("p"))
    month = W.partitionBy("t")
    q = q.withColumns({"stacked": F.avg("q").over(month), "pooled": F.sum("p").over(month), "first": F.row_number().over(month.orderBy("universe")) == 1})
    kinds = [F.struct(n.alias("portfolio"), F.col(c).alias("q"), k.alias("keep")) for n, c, k in ((F.col("universe"), "q", F.lit(True)), (F.lit("pooled"), "pooled", F.col("first")), (F.lit("stacked"), "stacked", F.col("first")))]
    every = q.select(F.explode(F.array(*kinds)).alias("x")).select("x.*").filter("keep")
    out = scores(every, ("portfolio",), gamma)
    inside = ~F.col("portfolio").isin("pooled", "stacked")
    return out.withColumn("best_within", inside & (F.col("sharpe") == F.max(F.when(inside, F.col("sharpe"))).over(W.partitionBy())))


def model_minus_baseline(metrics: DataFrame, baseline: str, values: tuple[str, ...] = ("sharpe", "ce")) -> DataFrame:
    """Each model's metrics less the baseline's, by universe."""
    base = metrics.filter(F.col("model") == baseline).select("universe", *(F.col(v).alias(f"_{v}") for v in values))
    out = metrics.filter(F.col("model") != baseline).join(base, "universe")
    return out.select("universe", "model", *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def stopping_rule(metrics: DataFrame, gap: float = 0.158) -> DataFrame:
    """Whether each universe's best and worst Sharpe ratios differ by less than gap."""
    return metrics.groupBy("universe").agg((F.max("sharpe") - F.min("sharpe")).alias("gap")).withColumn("stop", F.col("gap") < gap)


def alignment_alarm(r2: DataFrame, limit: float = 0.05) -> DataFrame:
    return r2.withColumn("alarm", F.coalesce(F.col("r2") > limit, F.lit(False)))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two runs' forecasts, and that over the mean size of a forecast."""
    both = a.select("universe", "asset", "t", F.col("predicted").alias("x")).join(b.select("universe", "asset", "t", F.col("predicted").alias("y")), ["universe", "asset", "t"])
    return both.groupBy("universe").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.try_divide(F.max(F.abs(F.col("x") - F.col("y"))), F.avg(F.abs("x"))).alias("relative"))


def coverage(df: DataFrame, by: tuple[str, ...] = U, level: float = 0.95) -> DataFrame:
    """Coverage and mean width of both intervals, their ratio, and the binomial standard error."""
    inside = lambda lo, hi: F.avg(F.col("realised").between(F.col(lo), F.col(hi)).cast("double"))
    width = lambda lo, hi: F.avg(F.col(hi) - F.col(lo))
    return df.groupBy(*by).agg(
        inside("lo_coef", "hi_coef").alias("cover_coef"),
        inside("lo_full", "hi_full").alias("cover_full"),
        width("lo_coef", "hi_coef").alias("width_coef"),
        width("lo_full", "hi_full").alias("width_full"),
        F.try_divide(width("lo_coef", "hi_coef"), width("lo_full", "hi_full")).alias("width_ratio"),
        F.sqrt(F.lit(level * (1 - level)) / F.count(F.lit(1))).alias("se"),
        F.count(F.lit(1)).alias("n"),
    )
