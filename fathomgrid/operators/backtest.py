"""Expanding-window backtests: refits run in parallel, forecasts join coefficients by an arithmetic as-of key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import dot

from . import scan

START, REFIT_EVERY = 240, 12
#: Bytes of a dense panel that a task is sent. A larger universe is refused: its assets' joint covariance needs it whole.
PANEL_BYTES = 256 << 20
#: Rows of refits up to which they are broadcast.
BROADCAST_REFITS = 10_000
FitFn = Callable[[np.ndarray, np.ndarray], np.ndarray]


def refit_key(t: Column, start: int = START, every: int = REFIT_EVERY) -> Column:
    """The latest refit at or before t: an as-of join by an equal key."""
    return (F.lit(start) + F.floor((t - start) / every) * every).cast("int")


def expanding_benchmark(df: DataFrame, value: str = "r_next", keys: tuple[str, ...] = ("universe", "asset")) -> DataFrame:
    """benchmark: mean of the rows strictly before, updated every month."""
    return scan.mean_before(df, value, keys, "t", "benchmark")


def ar1_fits(df: DataFrame, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Rows from start on with the regression of r_next on ret over the rows before their refit (a, b), the mean of
    those rows (prefix) and the benchmark; all as window aggregates."""
    w = W.partitionBy("universe", "asset").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    fits = df.filter("r_next is not null and ret is not null").withColumns(
        {"benchmark": F.avg("r_next").over(w), "a": F.regr_intercept("r_next", "ret").over(w), "b": F.regr_slope("r_next", "ret").over(w)}
    )
    # the refit's coefficients stand on its own row, so the same partitioning serves
    at = W.partitionBy("universe", "asset", "t_refit").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    out = fits.filter(F.col("t") >= start).withColumn("t_refit", refit_key(F.col("t"), start, every))
    out = out.withColumns({"a": F.first("a").over(at), "b": F.first("b").over(at), "prefix": F.first("benchmark").over(at)})
    return out.select("universe", "asset", "month", "t", "t_refit", "a", "b", "ret", "prefix", F.col("r_next").alias("realised"), "benchmark")


def ar1_forecasts(df: DataFrame, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Forecasts of r_next by its regression on ret over the rows before each refit."""
    return ar1_fits(df, start, every).select("universe", "asset", "month", "t", "t_refit", (F.col("a") + F.col("b") * F.col("ret")).alias("predicted"), "realised", "benchmark")


def ar1_coefficients(df: DataFrame, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Intercept and slope of every refit: (universe, asset, t_refit, b array)."""
    return ar1_fits(df, start, every).filter(F.col("t") == F.col("t_refit")).select("universe", "asset", "t_refit", F.array("a", "b").alias("b"))


def prefix_mean_forecasts(df: DataFrame, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Forecasts by the mean of the rows before each refit."""
    return ar1_fits(df, start, every).select("universe", "asset", "month", "t", "t_refit", F.col("prefix").alias("predicted"), "realised", "benchmark")


def dense(panel: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Assets, R (assets, months) and F (assets, months, predictors) of one universe's balanced rows (asset, t, f, r_next).

    Counted first: a universe that doesn't fit PANEL_BYTES is refused here.
    """
    size = panel.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("f")).alias("k")).first()
    if size["n"] * ((size["k"] or 0) + 1) * 8 > PANEL_BYTES:
        raise ValueError("the universe is too large for one dense panel: fit it by asset")
    rows = panel.select("asset", "t", "f", "r_next").orderBy("asset", "t").toPandas()
    assets = sorted(rows["asset"].unique())
    n = len(assets)
    if not n or len(rows) % n:
        raise ValueError("the panel isn't balanced")
    months = len(rows) // n
    f = np.stack(rows["f"].to_numpy()).astype(float).reshape(n, months, -1)
    return assets, rows["r_next"].to_numpy(float).reshape(n, months), f


def check_arrays(r: np.ndarray, f: np.ndarray) -> None:
    if r.ndim != 2 or f.ndim != 3 or f.shape[:2] != r.shape:
        raise ValueError(f"R {r.shape} and F {f.shape} don't match (assets, months[, predictors])")


def coefficients(panel: DataFrame, fit: FitFn, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Coefficients of every refit: (t_refit, asset, b array), each refit a task of its own on rows t < t_refit."""
    spark = panel.sparkSession
    assets, r, f = dense(panel)
    check_arrays(r, f)
    months = r.shape[1]
    if start >= months:
        raise ValueError(f"start {start} leaves none of {months} months to forecast")
    sent = spark.sparkContext.broadcast((assets, r, f))  # at most PANEL_BYTES
    refits = list(range(start, months, every))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, returns, predictors = sent.value
        for batch in batches:
            for t in batch["id"]:
                t = int(start + every * t)
                b = np.asarray(fit(returns[:, :t], predictors[:, :t]), float)
                yield pd.DataFrame({"t_refit": t, "asset": names, "b": [row.tolist() for row in b]})

    return spark.range(0, len(refits), 1, len(refits)).mapInPandas(run, "t_refit int, asset string, b array<double>")


def forecasts(panel: DataFrame, fits: DataFrame, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Every row from start on with the forecast f'b of its refit and the benchmark; fits with a universe are met by it."""
    rows = expanding_benchmark(panel.filter("r_next is not null"), keys=tuple(k for k in ("universe", "asset") if k in panel.columns))
    rows = rows.filter(F.col("t") >= start).withColumn("t_refit", refit_key(F.col("t"), start, every))
    keys = [c for c in ("universe", "asset", "month", "t", "t_refit") if c in rows.columns]
    return rows.join(fits, [c for c in ("universe", "asset", "t_refit") if c in fits.columns]).select(*keys, dot(F.col("f"), F.col("b")).alias("predicted"), F.col("r_next").alias("realised"), "benchmark")


def expanding_window(panel: DataFrame, fit: FitFn, start: int = START, every: int = REFIT_EVERY) -> DataFrame:
    """Backtest of one universe's panel (asset, t, f, r_next). Row t's response is known only after t: no further lag."""
    return forecasts(panel, coefficients(panel, fit, start, every), start, every)


def lookahead(run: Callable[[DataFrame], DataFrame], panel: DataFrame, corrupt_from: int, every: int = REFIT_EVERY, noise: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest change of forecasts when returns from corrupt_from on are replaced: (by, before, after).

    Forecasts of refits with t_refit <= corrupt_from must not change (before = 0), later ones must (after > 0).
    """
    a, b = run(panel), run(_corrupted(panel, corrupt_from, noise))
    keys = [c for c in ("universe", "asset", "t", "t_refit") if c in a.columns]
    both = a.select(*keys, "predicted").join(b.select(*keys, F.col("predicted").alias("other")), keys)
    change = F.abs(F.col("predicted") - F.col("other"))
    safe = F.col("t_refit") <= corrupt_from
    return both.groupBy(*by).agg(F.max(F.when(safe, change)).alias("before"), F.max(F.when(~safe, change)).alias("after"))


def lookahead_coefficients(run: Callable[[DataFrame], DataFrame], panel: DataFrame, corrupt_from: int, noise: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The same of coefficients (keys, t_refit, b array): their largest change by refits up to corrupt_from and after."""
    a, b = run(panel), run(_corrupted(panel, corrupt_from, noise))
    keys = [c for c in ("universe", "asset", "t_refit") if c in a.columns]
    both = a.select(*keys, F.posexplode("b").alias("k", "x")).join(b.select(*keys, F.posexplode("b").alias("k", "y")), [*keys, "k"])
    change, safe = F.abs(F.col("x") - F.col("y")), F.col("t_refit") <= corrupt_from
    return both.groupBy(*by).agg(F.max(F.when(safe, change)).alias("before"), F.max(F.when(~safe, change)).alias("after"))


def _corrupted(panel: DataFrame, corrupt_from: int, noise: float) -> DataFrame:
    return panel.withColumn("r_next", F.when(F.col("t") >= corrupt_from, F.lit(noise) * F.sin(F.col("t") * 12.9898 + F.length("asset"))).otherwise(F.col("r_next")))


def assert_unchanged(run: Callable[[DataFrame], DataFrame], panel: DataFrame, corrupt_from: int, every: int = REFIT_EVERY) -> None:
    """Raises unless returns from corrupt_from on change the later forecasts of run, and only these."""
    found = lookahead(run, panel, corrupt_from, every).first()
    if found["before"] != 0.0:
        raise AssertionError(f"forecasts before the corruption changed by {found['before']}")
    if not found["after"] > 0:
        raise AssertionError("forecasts after the corruption did not change: the test has no power")


def assert_no_lookahead(fit: FitFn, panel: DataFrame, corrupt_from: int, start: int = START, every: int = REFIT_EVERY) -> None:
    assert_unchanged(lambda p: expanding_window(p, fit, start, every), panel, corrupt_from, every)
    fits = lookahead_coefficients(lambda p: coefficients(p, fit, start, every), panel, corrupt_from).first()
    if fits["before"] != 0.0:
        raise AssertionError(f"coefficients before the corruption changed by {fits['before']}")


def refit_schedules(panel: DataFrame, fit: FitFn, schedules: list[tuple[int, int]]) -> DataFrame:
    """Backtests under several (start, refit_every), told apart by those columns."""
    out = None
    for start, every in schedules:
        one = expanding_window(panel, fit, start, every).withColumn("start", F.lit(start)).withColumn("refit_every", F.lit(every))
        out = one if out is None else out.unionByName(one)
    return out


def intervals(panel: DataFrame, fit_draws: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: int = START, every: int = REFIT_EVERY, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Equal-tailed intervals of every forecast: coefficients only, and the full predictive.

    fit_draws gives draws of B (draws, assets, predictors) and of the residual variances (draws, assets). The residual
    noise of a forecast is seeded by its month and asset, so that results don't depend on partitioning.
    """
    spark = panel.sparkSession
    rows = panel.filter("r_next is not null")
    assets, r, f = dense(rows)
    check_arrays(r, f)
    sent = spark.sparkContext.broadcast((assets, r, f))
    refits = list(range(start, r.shape[1], every))
    tails = [(1 - level) / 2, (1 + level) / 2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, returns, predictors = sent.value
        for batch in batches:
            for i in batch["id"]:
                t0 = int(start + every * i)
                b, s2 = fit_draws(returns[:, :t0], predictors[:, :t0])
                out = []
                for t in range(t0, min(t0 + every, returns.shape[1])):
                    for a, name in enumerate(names):
                        mu = b[:, a] @ predictors[a, t]
                        noise = np.random.default_rng([seed, t, a]).standard_normal(len(mu)) * np.sqrt(s2[:, a])
                        out.append((t, name, t0, *np.quantile(mu, tails), *np.quantile(mu + noise, tails), float(mu.mean()), float(returns[a, t])))
                yield pd.DataFrame(out, columns=["t", "asset", "t_refit", "lo_coef", "hi_coef", "lo_full", "hi_full", "predicted", "realised"])

    return spark.range(0, len(refits), 1, len(refits)).mapInPandas(run, "t int, asset string, t_refit int, lo_coef double, hi_coef double, lo_full double, hi_full double, predicted double, realised double")


def training_rows(panel: DataFrame, refits: DataFrame) -> DataFrame:
    """Rows t < t_refit of every refit (range join, within the columns that both sides have); fitters slice a dense panel instead.

    refits is broadcast if it has at most BROADCAST_REFITS rows, else Spark chooses the join.
    """
    shared = [c for c in refits.columns if c in panel.columns]
    side = F.broadcast(refits) if refits.count() <= BROADCAST_REFITS else refits
    joined = panel.join(side, shared) if shared else panel.crossJoin(side)
    return joined.filter(F.col("t") < F.col("t_refit"))
