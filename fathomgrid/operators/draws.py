"""Posterior draws (field, i, j, chain, draw, value): summaries and convergence diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import normal_quantile

from . import order, scan, sizes

P = ("field", "i", "j")
#: Ranges of values that divergence_positions ranks by themselves.
RANK_PARTS = 64


def truncated(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """Draws numbered below the shortest chain's length."""
    lengths = draws.groupBy(*by, "chain").agg(F.max("draw").alias("_m")).groupBy(*by).agg((F.min("_m") + 1).alias("_n"))
    return draws.join(lengths, list(by)).filter("draw < _n").drop("_n")


def prefix(draws: DataFrame, lengths: list[int]) -> DataFrame:
    """Draws below each of several lengths, told apart by n."""
    n = F.explode(F.array(*map(F.lit, lengths))).alias("n")
    return draws.select("*", n).filter("draw < n")


def posterior_mean(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    return truncated(draws, by).groupBy(*by).agg(F.avg("value").alias("mean"))


def credible_interval(draws: DataFrame, level: float = 0.95, by: tuple[str, ...] = P) -> DataFrame:
    return order.quantiles(draws, "value", by, {"lo": (1 - level) / 2, "hi": (1 + level) / 2})


def excluding_zero(intervals: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    return intervals.groupBy(*by).agg(F.count_if(F.col("lo") * F.col("hi") > 0).alias("n_excluding"), F.count(F.lit(1)).alias("n"))


def shrinkage_ratio(a: DataFrame, b: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """Norm ratio, ratio of median sizes and correlation of two tables of means."""
    both = a.select(*by, F.col("mean").alias("x")).join(b.select(*by, F.col("mean").alias("y")), list(by))
    return both.groupBy("field").agg(
        F.try_divide(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("norm_ratio"),
        F.try_divide(F.median(F.abs("x")), F.median(F.abs("y"))).alias("median_ratio"),
        F.corr("x", "y").alias("corr"),
    )


def scale_means(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """Means of a positive parameter and of its inverse (not the inverse of the mean)."""
    return draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.avg(1.0 / F.col("value")).alias("mean_inverse"))


def energy_fraction(stats: DataFrame, by: tuple[str, ...] = ("chain",)) -> DataFrame:
    """E-BFMI by chain: squared steps of the energy over squared deviations."""
    w = W.partitionBy(*by)
    d = stats.withColumns({"_d": F.col("energy") - F.lag("energy").over(w.orderBy("draw")), "_c": F.col("energy") - F.avg("energy").over(w)})
    return d.groupBy(*by).agg(F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("_c") * F.col("_c"))).alias("ebfmi"))


def sampler_summary(stats: DataFrame, max_depth: int = 10, by: tuple[str, ...] = ("chain",)) -> DataFrame:
    """Divergences, mean depth, share of saturated trees and the last step size, by chain."""
    return stats.groupBy(*by).agg(
        F.count_if("diverging").alias("n_divergent"),
        F.avg("tree_depth").alias("mean_depth"),
        F.avg((F.col("tree_depth") >= max_depth).cast("double")).alias("saturated"),
        F.max_by("step_size", "draw").alias("step_size"),
    )


def divergence_positions(stats: DataFrame, value: str) -> DataFrame:
    """For each divergent draw: the share of other draws with smaller values, by rank instead of by pairs."""
    edges = sorted(set(stats.approxQuantile(value, [i / RANK_PARTS for i in range(1, RANK_PARTS)], 0.001)))
    part = F.lit(0)
    for e in edges:
        part = part + (F.col("x") >= e).cast("int")
    x = stats.select(F.col(value).alias("x"), (~F.col("diverging")).cast("int").alias("n")).withColumn("part", part)
    # draws in lower parts, a row for each part, and those below in its own
    sizes = x.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    first = F.broadcast(sizes.select("part", before.alias("first"), F.sum("size").over(W.partitionBy()).alias("total")))  # RANK_PARTS rows
    own = W.partitionBy("part")
    below = F.sum("n").over(own.orderBy("x").rangeBetween(W.unboundedPreceding, 0)) - F.sum("n").over(W.partitionBy("part", "x"))
    ranked = x.withColumn("below", below).filter("n = 0").join(first, "part")
    return ranked.select("x", ((F.col("first") + F.col("below")) / F.greatest("total", F.lit(1))).alias("position"))


def rank_normalised(draws: DataFrame, by: tuple[str, ...] = P, value: str = "value") -> DataFrame:
    """z: normal scores of average-tie ranks over all chains and draws of a parameter."""
    r = order.ranked(draws, value, by, "rank", "_s")
    return r.withColumn("z", normal_quantile((F.col("rank") - 0.375) / (F.col("_s") + 0.25))).drop("_s")


def split(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """half: each chain's first and last floor(n/2) draws as chains of their own; an odd middle draw goes."""
    d = scan.numbered(draws, (*by, "chain"), "draw", "_at", count="_rows")
    half = F.when(F.col("_at") < F.floor(F.col("_rows") / 2), 0).when(F.col("_at") >= F.col("_rows") - F.floor(F.col("_rows") / 2), 1)
    return d.withColumn("half", half).filter("half is not null").drop("_rows", "_at")


def classic_rhat(draws: DataFrame, value: str = "value", by: tuple[str, ...] = P, chain: tuple[str, ...] = ("chain",)) -> DataFrame:
    """sqrt(((n-1)/n W + B/n) / W) from variances within chains and of their means; null if nothing varies."""
    c = draws.groupBy(*by, *chain).agg(F.var_samp(value).alias("_v"), F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_k"))
    return c.groupBy(*by).agg(_potential("_v", "_m", "_k").alias("rhat"))


def _potential(variance: str, mean: str, size: str) -> Column:
    """R-hat of a group of chains, as an aggregate of their variances, means and lengths."""
    within, n = F.avg(variance), F.min(size)
    return F.when(within > 0, F.sqrt(F.try_divide((n - 1) / n * within + F.var_samp(mean), within)))


def rank_rhat(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """Largest of the rank-normalised split R-hat of the values and of their distances to the median. Ranks come first."""
    rows = sizes.placed(draws, by)
    return _tallied_rhat(_tallied(rows, sizes.shortest(rows, by), by), by)


def _tallied(rows: DataFrame, short: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Placed draws counted by value (by, chain, _half, _kept, value, _n), settled: all that ranks and quantiles need.

    _half: the chain's first or last floor(n/2) draws, null in the middle; _kept: within the shortest chain.
    """
    half = F.floor(F.col("_rows") / 2)
    side = F.when(F.col("_place") < half, 0).when(F.col("_place") >= F.col("_rows") - half, 1)
    kept = rows.join(short, list(by)).select(*by, "chain", side.alias("_half"), (F.col("_place") < F.col("_n")).alias("_kept"), "value")
    return order.settled(kept.groupBy(*by, "chain", "_half", "_kept", "value").agg(F.count(F.lit(1)).alias("_n")))


def _values(tally: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return order.settled(tally.filter("value is not null").groupBy(*by, F.col("value").alias("_v")).agg(F.sum("_n").alias("_n")))


def _tallied_rhat(tally: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rank_rhat from counted values; chains' variances take two steps, as their means may be far from 0."""
    values = _values(tally, by)
    middle = order.sent(order.counted_quantiles(values, by, {"_m": 0.5}))
    apart = order.settled(values.join(middle, list(by)).withColumn("_apart", F.abs(F.col("_v") - F.col("_m"))).drop("_m"))
    folded = order.settled(apart.groupBy(*by, F.col("_apart").alias("_v")).agg(F.sum("_n").alias("_n")))
    score = normal_quantile((F.col("_rank") - 0.375) / (F.col("_all") + 0.25))
    bulk = order.counted_ranks(apart, by).select(*by, F.col("_v").alias("value"), "_apart", score.alias("bulk"))
    tail = order.counted_ranks(folded, by).select(*by, F.col("_v").alias("_apart"), score.alias("tail"))
    scores = bulk.join(tail, [*by, "_apart"]).drop("_apart")
    some = tally.filter("_half is not null").join(middle.select(*by), list(by), "left_semi")
    each = order.settled(some.join(scores, [*by, "value"], "left").select(*by, "chain", "_half", "_n", "bulk", "tail"))

    kinds, series = ("bulk", "tail"), (*by, "chain", "_half")
    one = {k: (F.sum(F.when(F.col(k).isNotNull(), F.col("_n"))).alias(f"{k}_n"), (F.sum(F.col("_n") * F.col(k)) / F.sum(F.when(F.col(k).isNotNull(), F.col("_n")))).alias(f"{k}_m"), (F.min(k) < F.max(k)).alias(f"{k}_varies")) for k in kinds}
    chains = order.sent(each.groupBy(*series).agg(F.sum("_n").alias("_k"), *(c for k in kinds for c in one[k])))
    of = chains.select(*(F.col(c).alias(f"_of_{c}") for c in series), *(f"{k}_m" for k in kinds))
    same = F.lit(True)
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    of = F.broadcast(of) if chains.count() * 128 <= order.BROADCAST_BYTES else of
    squares = each.join(of, same).groupBy(*series).agg(*(F.sum(F.col("_n") * (F.col(k) - F.col(f"{k}_m")) * (F.col(k) - F.col(f"{k}_m"))).alias(f"{k}_s") for k in kinds))
    found = squares.select(*(F.col(c).alias(f"_of_{c}") for c in series), *(f"{k}_s" for k in kinds)).join(chains, same)
    found = found.withColumns({f"{k}_v": F.when(F.col(f"{k}_n") > 1, F.when(F.col(f"{k}_varies"), F.col(f"{k}_s") / (F.col(f"{k}_n") - 1)).otherwise(0.0)) for k in kinds})
    both = found.groupBy(*by).agg(*(_potential(f"{k}_v", f"{k}_m", "_k").alias(k) for k in kinds))
    return both.select(*by, "bulk", "tail", F.greatest("bulk", "tail").alias("rhat"))


def autocovariance(draws: DataFrame, lags: int, by: tuple[str, ...] = (*P, "chain"), value: str = "value") -> DataFrame:
    """Autocovariance (over n) at lags 0..lags of each chain, as window lags; for volume see effective_sizes."""
    w = W.partitionBy(*by)
    d = draws.withColumn("_c", F.col(value) - F.avg(value).over(w))
    shifted = [F.lag("_c", k).over(w.orderBy("draw")).alias(f"_l{k}") for k in range(lags + 1)]
    d = d.select(*by, "_c", *shifted).groupBy(*by).agg(F.array(*(F.sum(F.col("_c") * F.col(f"_l{k}")) / F.count(F.lit(1)) for k in range(lags + 1))).alias("_a"))
    return d.select(*by, F.posexplode("_a").alias("lag", "acov"))


def _acov(x: np.ndarray) -> np.ndarray:
    """Autocovariance of each row at all lags, by FFT."""
    n = x.shape[1]
    f = np.fft.rfft(x - x.mean(axis=1, keepdims=True), 2 * n, axis=1)
    return np.fft.irfft(f * np.conj(f), axis=1)[:, :n] / n


def single_effective_size(x: np.ndarray) -> float:
    """Effective draws of one chain as it is, not split: 1 + 2 sums of autocorrelations up to the last pair of lags
    (2k - 1, 2k) before one whose sum is negative. A chain that doesn't vary counts whole."""
    x = np.asarray(x, float)
    n = len(x)
    a = _acov(x[None])[0]
    if not a[0] > 0:
        return float(n)
    rho = a[1 : n - 1] / a[0]
    pairs = rho[: len(rho) // 2 * 2].reshape(-1, 2).sum(axis=1)
    negative = np.flatnonzero(pairs < 0)
    used = 2 * negative[0] if len(negative) else max(0, len(rho) - 2)
    return float(n / max(1.0, 1 + 2 * rho[:used].sum()))


def effective_size(chains: np.ndarray) -> float:
    """Effective draws of raw chains (chains, draws), split in halves, by initial positive pairs of autocorrelations."""
    half = chains.shape[1] // 2
    x = np.concatenate([chains[:, :half], chains[:, chains.shape[1] - half :]])
    m, n = x.shape
    if n < 4 or not np.isfinite(x).all():
        return float("nan")
    a = _acov(x)
    within = (a[:, 0] * n / (n - 1)).mean()
    total = (n - 1) / n * within + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if not within > 0 or not total > 0:
        return float("nan")
    rho = 1 - (within - a.mean(axis=0)) / total
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs <= 0)
    used = pairs[: stop[0]] if len(stop) else pairs
    tau = max(-1 + 2 * used.sum(), 1 / np.log10(max(m * n, 11)))
    return float(m * n / tau)


def effective_sizes(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """(ess_bulk, ess_tail) of every parameter, from blocks of its chains (see sizes)."""
    return sizes.effective_sizes(draws, by)


def diagnosed(draws: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """R-hat and effective sizes of every parameter. Draws are placed once and counted by value once for both."""
    rows = sizes.placed(draws, by)
    short = sizes.shortest(rows, by)
    tally = _tallied(rows, short, by)
    tails = order.counted_quantiles(_values(tally.filter("_kept"), by), by, sizes.TAILS)
    return _tallied_rhat(tally, by).select(*by, "rhat").join(sizes.of_placed(rows, short, tails, by), list(by))


def diagnosis_summary(d: DataFrame) -> DataFrame:
    return d.groupBy("field").agg(F.max("rhat").alias("max_rhat"), F.min("ess_bulk").alias("min_bulk"), F.min("ess_tail").alias("min_tail"), F.count(F.lit(1)).alias("n"))


def chain_budget(draws: DataFrame, lengths: list[int], by: tuple[str, ...] = P, target: float = 1.01) -> DataFrame:
    """(R-hat - 1) x ESS by prefix length, which should be steady, and the draws that would bring R-hat to target."""
    d = prefix(draws, lengths)
    out = diagnosed(d, ("n", *by))
    return out.withColumn("product", (F.col("rhat") - 1) * F.col("ess_bulk")).withColumn("implied", F.try_divide(F.col("n") * (F.col("rhat") - 1), F.lit(target - 1)))


def runs_agree(a: DataFrame, b: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """z of the difference of two runs' means over their Monte Carlo errors."""
    side = lambda d, s: d.groupBy(*by).agg(F.avg("value").alias(f"m{s}"), F.var_samp("value").alias(f"v{s}")).join(effective_sizes(d, by).select(*by, F.col("ess_bulk").alias(f"e{s}")), list(by))
    both = side(a, "a").join(side(b, "b"), list(by))
    return both.select(*by, F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt(F.try_divide("va", "ea") + F.try_divide("vb", "eb"))).alias("z"))


def agreement_z(means: DataFrame, by: tuple[str, ...] = P) -> DataFrame:
    """The same from a table of means, variances and effective sizes of runs a and b."""
    return means.select(*by, F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt(F.try_divide("va", "ea") + F.try_divide("vb", "eb"))).alias("z"))


def top_k(means: DataFrame, k: int, setting: str = "setting") -> DataFrame:
    w = W.partitionBy(setting).orderBy(F.desc(F.abs("mean")), "j")
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spearman(means: DataFrame, setting: str = "setting") -> DataFrame:
    """Correlation of ordinal ranks of |mean| for each pair of settings."""
    r = means.withColumn("r", F.row_number().over(W.partitionBy(setting).orderBy(F.abs("mean"), "j")).cast("double"))
    a, b = (r.select("j", F.col(setting).alias(n), F.col("r").alias(f"r_{n}")) for n in "ab")
    return a.join(b, "j").filter("a < b").groupBy("a", "b").agg(F.corr("r_a", "r_b").alias("rho"))


def rank_stability(means: DataFrame, k: int, setting: str = "setting") -> DataFrame:
    """Rank correlation and overlap of the k largest, for each pair of settings."""
    t = top_k(means, k, setting)
    a, b = (t.select("j", F.col(setting).alias(n)) for n in "ab")
    overlap = a.join(b, "j").filter("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("overlap"))
    return spearman(means, setting).join(overlap, ["a", "b"], "left").fillna({"overlap": 0.0})


def stable_core(means: DataFrame, k: int, setting: str = "setting") -> DataFrame:
    """How many settings have a predictor among their k largest, and whether all have."""
    n = means.select(setting).distinct().agg(F.count(F.lit(1)).alias("_n"))
    member = top_k(means, k, setting).groupBy("j").agg(F.count_distinct(setting).alias("n_settings"))
    return member.crossJoin(F.broadcast(n)).select("j", "n_settings", (F.col("n_settings") == F.col("_n")).alias("core"))


# Multipliers and modulus of the order in which half_split_stability deals draws.
SHUFFLE, MODULUS = (7919, 104_729, 1_299_709, 48_271), (1 << 31) - 1
#: Its orders are searched by ranges of 1 << RANGE_BITS numbers, of which there are 4,096.
RANGE_BITS = 19


def _shuffled(rep: Column) -> Column:
    """A draw's number in a repetition's order, in 64 bits however long the chains are; without chain the last."""
    a1, a2, a3, a4 = SHUFFLE
    chain, draw, rep = (c.cast("long") + 1 for c in (F.col("chain"), F.col("draw"), rep))
    return F.coalesce((chain * a1 + draw * a2 + rep * a3) % MODULUS * a4 % MODULUS, F.lit(MODULUS).cast("long"))


def _last_of_half(pooled: DataFrame, reps: int) -> DataFrame:
    """(rep, cut): the place (mixed, chain, draw) of the last draw in each repetition's first half; no row without one.

    Numbers are counted by ranges, and only the range that has the cut is sorted.
    """
    rows = pooled.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("mixed", _shuffled(F.col("rep")))
    rows = rows.withColumn("range", F.shiftright("mixed", RANGE_BITS))
    sizes_ = rows.groupBy("rep", "range").agg(F.count(F.lit(1)).alias("size"))
    own = W.partitionBy("rep")  # a row for each range
    sizes_ = sizes_.withColumn("below", F.sum("size").over(own.orderBy("range")) - F.col("size")).withColumn("half", F.floor(F.sum("size").over(own) / 2))
    held = sizes_.filter("half > below AND half <= below + size").select("rep", "range", (F.col("half") - F.col("below")).alias("at"))
    near = rows.join(F.broadcast(held), ["rep", "range"])
    nth = F.row_number().over(own.orderBy("mixed", "chain", "draw"))
    return near.withColumn("nth", nth).filter("nth = at").select("rep", F.struct("mixed", "chain", "draw").alias("cut"))


def half_split_stability(draws: DataFrame, reps: int = 20, k: int = 20) -> DataFrame:
    """How well rankings of |means| from two random halves of one setting's draws (j, chain, draw, value) agree.

    Median and 10 % quantile over repetitions of the rank correlation and of the overlap of the k largest. Chains are
    cut to the shortest; a repetition orders the pooled draws by a generator's numbers, the first half of them (rounded
    down) is a, the rest b.
    """
    kept = order.settled(truncated(order.settled(draws.select("j", "chain", "draw", "value")), ("j",)))
    pooled = kept.select("chain", "draw").distinct()
    cuts = F.broadcast(_last_of_half(pooled, reps))  # a row for each repetition
    place = F.struct(_shuffled(F.col("rep")).alias("mixed"), "chain", "draw")
    sides = kept.filter("chain is not null").crossJoin(cuts).withColumn("setting", F.when(place <= F.col("cut"), "a").otherwise("b"))
    means = sides.groupBy("rep", "setting", "j").agg(F.avg("value").alias("mean"))
    w = W.partitionBy("rep", "setting")
    r = means.withColumn("r", F.row_number().over(w.orderBy(F.abs("mean"), "j")).cast("double")).withColumn("top", F.row_number().over(w.orderBy(F.desc(F.abs("mean")), "j")) <= k)
    a, b = (r.filter(F.col("setting") == n).select("rep", "j", F.col("r").alias(n), F.col("top").alias(f"top_{n}")) for n in "ab")
    one = a.join(b, ["rep", "j"]).groupBy("rep").agg(F.corr("a", "b").alias("rho"), (F.count_if(F.col("top_a") & F.col("top_b")) / F.lit(float(k))).alias("overlap"))
    return one.agg(*(f.alias(f"{n}_{c}") for c in ("rho", "overlap") for n, f in (("median", F.median(c)), ("p10", F.percentile(c, 0.1)))))


def traces(draws: DataFrame, field: str, n: int = 3, seed: int = 0) -> DataFrame:
    """Draws of n elements of a field, chosen by a seed that doesn't depend on the chains."""
    known = [tuple(r) for r in draws.filter(F.col("field") == field).select("i", "j").distinct().orderBy("i", "j").collect()]  # parameters of one field
    chosen = np.random.default_rng(seed).choice(len(known), min(n, len(known)), replace=False)
    keep = F.lit(False)
    for c in chosen:
        keep = keep | (F.col("i").eqNullSafe(known[c][0]) & F.col("j").eqNullSafe(known[c][1]))
    return draws.filter((F.col("field") == field) & keep)


def scale_summary(draws: DataFrame, prior: float, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Global scale against its prior: mean, 95% interval, ratio, whether the prior is outside, distance in posterior sd."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    g = draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return g.select(*by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), (F.col("mean") / prior).alias("ratio"), ((F.col("q")[0] > prior) | (F.col("q")[1] < prior)).alias("prior_excluded"), F.try_divide(F.lit(prior) - F.col("mean"), F.col("sd")).alias("distance_sd"))


def chain_means(draws: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Mean, sd and quantiles by chain: several modes show as chains apart."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = draws.groupBy(*by, "chain").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return g.select(*by, "chain", "mean", "sd", F.col("q")[0].alias("lo"), F.col("q")[1].alias("median"), F.col("q")[2].alias("hi"))


def slab_summary(draws: DataFrame, tolerance: float = 0.99, halved: float = 0.5) -> DataFrame:
    """Binding of the slab by chain, from wide rows (chain, lam, lam_tilde, tau, c): shares of ratios below limits."""
    ratio = F.try_divide("lam_tilde", "lam")
    return draws.groupBy("chain").agg(F.avg((ratio < tolerance).cast("double")).alias("binding"), F.avg((ratio < halved).cast("double")).alias("halved"), F.avg("c").alias("mean_c"), F.avg("tau").alias("mean_tau"), F.avg(ratio).alias("mean_ratio"))


def _chain_mean(draws: DataFrame, by: tuple[str, ...], *columns: str) -> DataFrame:
    """Means over chains of the chains' means."""
    own = draws.groupBy(*by, "chain").agg(*(F.avg(c).alias(c) for c in columns))
    return own.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def deviation_variance(draws: DataFrame, by: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Prior variance of deviations under a horseshoe: (mean tau x mean lam)^2 of wide rows (chain, tau, lam).

    lam is the local scale, or its regularised form; means are of the chains' means.
    """
    product = F.col("tau") * F.col("lam")
    return _chain_mean(draws, by, "tau", "lam").select(*by, (product * product).alias("variance"))


def gaussian_deviation_variance(draws: DataFrame, by: tuple[str, ...] = ("j",)) -> DataFrame:
    """The same under the Gaussian prior, for every asset alike: mean of the diagonal (chain, j, value)."""
    return _chain_mean(draws, by, "value").withColumnRenamed("value", "variance")


def lasso_deviation_variance(draws: DataFrame, s: float, by: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """The same under the LASSO of scale s: s^2 times the mean of tau^2 (chain, i, j, value)."""
    return _chain_mean(draws, by, "value").select(*by, (F.col("value") * s * s).alias("variance"))


def budget_validation(short: DataFrame, reference: DataFrame, reference_size: float, by: tuple[str, ...] = P) -> DataFrame:
    """A short run's draws against a full run's means: |difference of means| in Monte Carlo standard errors.

    The error is the short run's deviation times sqrt(1 / its draws + 1 / the full run's effective size). Returns by
    field median_z, max_z, the share of z below 3 (one without error isn't) and the correlation of the means.
    """
    own = short.groupBy(*by).agg(F.avg("value").alias("x"), (F.stddev_pop("value") * F.sqrt(1.0 / F.count("value") + 1.0 / reference_size)).alias("se"))
    both = own.join(reference.select(*by, F.col("mean").alias("y")), list(by))
    z = both.withColumn("z", F.try_divide(F.abs(F.col("x") - F.col("y")), "se"))
    return z.groupBy("field").agg(F.median("z").alias("median_z"), F.max("z").alias("max_z"), F.avg(F.coalesce(F.col("z") < 3, F.lit(False)).cast("double")).alias("within_3"), F.corr("x", "y").alias("corr"))
