"""Effective sizes of chains of any length: a chain is cut into blocks of draws, lags come in stretches of a block.

A block's products with the draws a stretch of lags ahead need the block there and the one after it, its halo. Sums by
lag are added over blocks and chains. Stretches are taken until every parameter's pairs of autocorrelations have met
the first that isn't positive: one stretch, then two more, then four, so that even a chain that never mixes takes few
rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from . import order, scan

#: Draws in a block and lags in a stretch; even, so that no pair of lags falls into two stretches.
BLOCK = 4_096
KINDS = ("bulk", "low", "high")
TAILS = {"_lo": 0.05, "_hi": 0.95}


@pandas_udf(ArrayType(DoubleType()))
def _products(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sums of (own - mean) times the values (near, far) - mean that are 0, 1, ... lags ahead, as many as a block has."""
    for own, near, far, mean, lags in parts:
        out = []
        for a, b, c, m, k in zip(own, near, far, mean, lags):
            ahead = np.asarray(b, float) if c is None else np.concatenate([b, c])
            size = 1 << int(2 * k + len(a) - 1).bit_length()
            there = np.fft.rfft(ahead[: 2 * k] - m, size) * np.conj(np.fft.rfft(np.asarray(a, float) - m, size))
            out.append(np.fft.irfft(there, size)[:k])
        yield pd.Series(out, dtype=object)


def placed(draws: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, chain, value, _place, _rows), settled: a draw's place in its chain and the chain's length."""
    rows = draws.select(*by, "chain", "draw", F.col("value").cast("double").alias("value"))
    return order.settled(scan.numbered(rows, (*by, "chain"), "draw", "_place", count="_rows").drop("draw"))


def shortest(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, _n): each parameter's shortest chain."""
    return order.sent(rows.groupBy(*by).agg(F.min("_rows").alias("_n")))


def _halves(rows: DataFrame, short: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, chain, _half, _at, _len, value): both halves of each chain, cut to the shortest; an odd middle draw goes."""
    rows = rows.join(short, list(by)).filter("_place < _n").withColumn("_len", F.floor(F.col("_n") / 2))
    second = F.col("_place") >= F.col("_n") - F.col("_len")
    rows = rows.withColumn("_half", F.when(F.col("_place") < F.col("_len"), 0).when(second, 1))
    return rows.withColumn("_at", F.col("_place") - F.when(second & (F.col("_half") == 1), F.col("_n") - F.col("_len")).otherwise(0))


def _blocks(halves: DataFrame, tails: DataFrame, by: tuple[str, ...], block: int) -> DataFrame:
    """(by, _kind, chain, _half, _len, _b, _x, _sum, _odd): values and indicators of both tails in blocks."""
    rows = halves.filter("_half is not null").join(tails, list(by), "left")
    rows = rows.withColumns({"low": (F.col("value") < F.col("_lo")).cast("double"), "high": (F.col("value") > F.col("_hi")).cast("double"), "bulk": F.col("value").cast("double")})
    odd = F.col("bulk").isNull() | F.isnan("bulk") | (F.abs("bulk") == float("inf"))
    got = rows.groupBy(*by, "chain", "_half", "_len", F.floor(F.col("_at") / block).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("_at", *KINDS))).alias("_rows"), *(F.sum(k).alias(f"_{k}") for k in KINDS), F.max(odd).alias("_odd")
    )
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(f"_rows.{k}").alias("_x"), F.col(f"_{k}").alias("_sum")) for k in KINDS)))
    return got.withColumn("_each", each).select(*by, "chain", "_half", "_len", "_b", "_odd", "_each.*")


def _summed(wide: DataFrame, series: list[str], by: list[str], first: int, width: int, block: int) -> DataFrame:
    """(by, _len, _lag, _sum) of the stretches from first on: products added over blocks, chains and halves."""
    if first == 0 and width == 1:
        pairs = wide.withColumn("_q", F.lit(0)).withColumns({"_near": F.col("_x"), "_far": F.col("_next")})
    else:
        own = wide.drop("_next").withColumn("_q", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1)))).withColumn("_to", F.col("_b") + F.col("_q"))
        ahead = wide.select(*series, F.col("_b").alias("_to"), F.col("_x").alias("_near"), F.col("_next").alias("_far"))
        pairs = own.join(ahead, [*series, "_to"])
    sums = pairs.select(*by, "_len", "_q", F.posexplode(_products("_x", "_near", "_far", "_mean", F.lit(block))).alias("_s", "_p"))
    return sums.groupBy(*by, "_len", (F.col("_q") * block + F.col("_s")).alias("_lag")).agg(F.sum("_p").alias("_sum")).filter("_lag < 2 * floor(_len / 2)")


def _paired(sums: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, _used, _stop): sum of the pairs of autocorrelations before the first that isn't positive, and its number."""
    acov = F.col("_sum") / (F.col("_len") * F.col("_m"))
    rho = F.when(F.col("_lag") == 0, 1.0).otherwise(1 - F.try_divide(F.col("_within") - acov, F.col("_total")))
    pairs = sums.drop("_len").join(stats, by).groupBy(*by, F.floor(F.col("_lag") / 2).alias("_t")).agg(F.sum(rho).alias("_p"))
    stop = F.min(F.when(F.col("_p") <= 0, F.col("_t"))).over(W.partitionBy(*by))
    before = F.col("_stop").isNull() | (F.col("_t") < F.col("_stop"))
    return pairs.withColumn("_stop", stop).groupBy(*by).agg(F.sum(F.when(before, F.col("_p")).otherwise(0.0)).alias("_used"), F.max("_stop").alias("_stop"))


def effective_sizes(draws: DataFrame, by: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """(by, ess_bulk, ess_tail): of the draws, and the lesser of both 5 % tails' indicators (chain, draw, value).

    Chains are cut to the shortest and split in halves, variances are combined as for R-hat, autocorrelations summed by
    initial positive pairs. Null if a half has fewer than four draws, a draw is null or not finite, or nothing varies;
    by must not be null.
    """
    rows = placed(draws, by)
    short = shortest(rows, by)
    return of_placed(rows, short, order.quantiles(_halves(rows, short, by), "value", by, TAILS), by, block)


def of_placed(rows: DataFrame, short: DataFrame, tails: DataFrame, by: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """effective_sizes of placed draws, given their shortest chains and the quantiles TAILS of the draws within these."""
    names = list(by)
    longest = (short.agg(F.max("_n")).first()[0] or 0) // 2
    several = longest > block
    blocks = order.settled(_blocks(_halves(rows, short, by), order.sent(tails), by, block))
    groups, series = [*names, "_kind"], [*names, "_kind", "chain", "_half"]
    means = blocks.groupBy(*series, "_len").agg((F.sum("_sum") / F.col("_len")).alias("_mean"), F.max("_odd").alias("_odd"))
    wide = blocks.drop("_sum", "_odd").join(means.drop("_len", "_odd"), series)
    if several:
        after = blocks.select(*series, (F.col("_b") - 1).alias("_b"), F.col("_x").alias("_next"))
        wide = order.settled(wide.join(after, [*series, "_b"], "left"))
    else:
        wide = wide.withColumn("_next", F.lit(None).cast("array<double>"))
    first, width, rounds = 0, 1, []
    sums = _summed(wide, series, groups, first, width, block)
    if several:
        sums = order.settled(sums)
    start = sums.filter("_lag = 0").select(*groups, (F.col("_sum") / F.col("_len")).alias("_zero"))
    stats = means.groupBy(*groups, "_len").agg(F.count(F.lit(1)).alias("_m"), F.var_samp("_mean").alias("_between"), F.max("_odd").alias("_odd")).join(start, groups, "left")
    stats = stats.withColumn("_within", F.try_divide(F.col("_zero") / F.col("_m") * F.col("_len"), F.col("_len") - 1))
    stats = stats.withColumn("_total", (F.col("_len") - 1) / F.col("_len") * F.col("_within") + F.col("_between"))
    if several:
        stats = order.settled(stats)
    while True:
        found = _paired(sums, stats, groups)
        rounds.append(order.settled(found) if several else found)
        if (first + width) * block >= longest:
            break
        more = F.col("_len") > (first + width) * block
        active = rounds[-1].filter("_stop is null").join(stats.filter(more).filter("_within > 0 AND _total > 0 AND NOT _odd"), groups).select(*groups)
        if active.isEmpty():
            break
        first, width = first + width, 2 * width
        sums = _summed(wide.join(active, groups, "left_semi"), series, groups, first, width, block)
    every = rounds[0]
    for found in rounds[1:]:
        every = every.unionByName(found)
    used = every.groupBy(*groups).agg(F.sum("_used").alias("_used"))
    draws_ = F.col("_m") * F.col("_len")
    tau = F.greatest(2 * F.col("_used") - 1, 1 / F.log10(F.greatest(draws_, F.lit(11))))
    ok = (F.col("_len") >= 4) & ~F.col("_odd") & (F.col("_within") > 0) & (F.col("_total") > 0)
    ess = stats.join(used, groups, "left").select(*groups, F.when(ok, draws_ / tau).alias("_ess"))
    of = {k: F.max(F.when(F.col("_kind") == k, F.col("_ess"))) for k in KINDS}
    return _with_short(ess.groupBy(*by).agg(of["bulk"].alias("ess_bulk"), F.when(of["low"].isNotNull() & of["high"].isNotNull(), F.least(of["low"], of["high"])).alias("ess_tail")), short, names)


def _with_short(found: DataFrame, every: DataFrame, by: list[str]) -> DataFrame:
    """A row for each parameter, those too short for halves included."""
    return every.select(*by).join(found, by, "left")
