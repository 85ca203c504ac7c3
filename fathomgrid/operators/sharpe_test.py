"""Difference of two Sharpe ratios: delta method with a HAC covariance, and the studentised circular block bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order

BLOCKS, REPLICATES = (2, 5, 10, 20), 4_999


def hac_difference(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """delta, se and t of the ratios of columns r1 and r2 over t (moments with n): series (r1, r2, r1^2, r2^2),
    Bartlett weights on floor(4 (n/100)^(2/9)) lags, gradient of the difference of ratios.
    """
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("r1").alias("m1"), F.avg("r2").alias("m2"), F.avg(F.col("r1") * F.col("r1")).alias("g1"), F.avg(F.col("r2") * F.col("r2")).alias("g2"))
    v1, v2 = F.col("g1") - F.col("m1") * F.col("m1"), F.col("g2") - F.col("m2") * F.col("m2")
    g = g.filter((v1 > 0) & (v2 > 0)).withColumns({"s1": F.pow(v1, F.lit(1.5)), "s2": F.pow(v2, F.lit(1.5)), "delta": F.col("m1") / F.sqrt(v1) - F.col("m2") / F.sqrt(v2), "lags": F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9))).cast("int")})
    # the gradient turns the four series into one, whose long-run variance is the quadratic form
    x = df.join(g, list(by)).withColumn(
        "z",
        F.col("g1") / F.col("s1") * (F.col("r1") - F.col("m1"))
        - F.col("g2") / F.col("s2") * (F.col("r2") - F.col("m2"))
        - F.col("m1") / (2 * F.col("s1")) * (F.col("r1") * F.col("r1") - F.col("g1"))
        + F.col("m2") / (2 * F.col("s2")) * (F.col("r2") * F.col("r2") - F.col("g2")),
    )
    x = x.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("t")))
    lagged = x.select(*by, F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("k"), (F.col("_i") + F.col("k")).alias("_i"), F.col("z").alias("y"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("k") / (F.col("lags") + 1.0)))
    psi = x.join(lagged, [*by, "_i"]).groupBy(*by).agg(F.sum(weight * F.col("z") * F.col("y") / F.col("n")).alias("psi"))
    out = g.join(psi, list(by)).withColumn("se", F.sqrt(F.greatest(F.col("psi"), F.lit(0.0)) / F.col("n")))
    return out.select(*by, "n", "lags", "delta", "se", F.try_divide("delta", "se").alias("t_stat"))


# Multipliers and modulus (a prime) of the counter-based numbers that choose block starts.
COUNTER, MODULUS = (48_271, 69_621, 16_807, 1_299_709), (1 << 31) - 1


def _fifth_power(x: Column) -> Column:
    square = x * x % MODULUS
    return square * square % MODULUS * x % MODULUS


def block_start(seed: int, block: Column, replicate: Column, number: Column, n: Column) -> Column:
    """A number below n from (seed, block length, replicate, number of the block) alone: fifth powers modulo a prime,
    which permute its residues, mixed with the counters twice. SQL computes the same."""
    a, b, c, d = COUNTER
    block, replicate, number = (x.cast("long") for x in (block, replicate, number))
    first = _fifth_power((replicate * a + number * b + block * c + seed % MODULUS * d + 1) % MODULUS)
    return _fifth_power((first + number * a + replicate * b + 1) % MODULUS) % n


def _block_sums(df: DataFrame, by: tuple[str, ...], blocks: tuple[int, ...]) -> DataFrame:
    """(by, block, start, whole, s1..s4): sums of the four centred series over every circular block, by prefix sums.

    whole is false for the shorter block that ends a sample. Blocks longer than the series are left out.
    """
    every = W.partitionBy(*by)
    series = {"s1": F.col("r1"), "s2": F.col("r2"), "s3": F.col("r1") * F.col("r1"), "s4": F.col("r2") * F.col("r2")}
    x = df.select(*by, "t", *((c - F.avg(c).over(every)).alias(k) for k, c in series.items()))
    so_far = every.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    x = x.select(*by, "t", *(F.sum(k).over(so_far).alias(k) for k in series))
    sums = x.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", *series))).alias("_p"), F.count(F.lit(1)).alias("n"))
    kinds = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.lit(w).alias("whole")) for b in blocks for w in (True, False))))
    sums = sums.select(*by, "n", "_p", kinds.alias("_k")).select(*by, "n", "_p", "_k.*").filter("block <= n")
    sums = sums.withColumn("_size", F.when(F.col("whole"), F.col("block")).otherwise(F.col("n") % F.col("block"))).filter("_size > 0")
    sums = sums.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("_end", F.col("start") + F.col("_size"))

    def until(k: str, place: Column) -> Column:
        return F.when(place == 0, 0.0).otherwise(F.element_at("_p", F.greatest(place, F.lit(1)).cast("int")).getField(k))

    circular = lambda k: F.when(F.col("_end") <= F.col("n"), until(k, F.col("_end"))).otherwise(until(k, F.col("n")) + until(k, F.col("_end") - F.col("n"))) - until(k, F.col("start"))
    return sums.select(*by, "block", "start", "whole", *(circular(k).alias(k) for k in series))


def _replicates(df: DataFrame, by: tuple[str, ...], blocks: tuple[int, ...], replicates: int, seed: int) -> DataFrame:
    """(by, block, rep, t_stat): |difference - delta| of every circular block sample over its blocks' own error."""
    pairs = [(i, j) for i in range(1, 5) for j in range(i, 5)]
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"o{i}") for i, c in enumerate((F.col("r1"), F.col("r2"), F.col("r1") * F.col("r1"), F.col("r2") * F.col("r2")), 1)))
    plan = base.select(*by, "n", F.explode(F.array(*map(F.lit, blocks))).alias("block")).filter("block <= n")
    plan = plan.repartition(*by, "block").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = plan.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("block")) - 1)))
    drawn = drawn.select(*by, "block", "rep", ((F.col("_j") + 1) * F.col("block") <= F.col("n")).alias("whole"), block_start(seed, F.col("block"), F.col("rep"), F.col("_j"), F.col("n")).alias("start"))
    met = drawn.join(_block_sums(df, by, blocks), [*by, "block", "start", "whole"])
    whole = lambda c: F.sum(F.when(F.col("whole"), c).otherwise(0.0))
    x = met.groupBy(*by, "block", "rep").agg(
        *(F.sum(f"s{i}").alias(f"d{i}") for i in range(1, 5)), *(whole(F.col(f"s{i}")).alias(f"w{i}") for i in range(1, 5)), *(whole(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}{j}") for i, j in pairs)
    )
    x = x.join(base, list(by))
    x = x.withColumns({f"d{i}": F.col(f"d{i}") / F.col("n") for i in range(1, 5)})  # the sample's means less the series'
    x = x.withColumns({f"m{i}": F.col(f"o{i}") + F.col(f"d{i}") for i in range(1, 5)})
    v1, v2, u1, u2 = (F.col(f"{c}{i + 2}") - F.col(f"{c}{i}") * F.col(f"{c}{i}") for c in "mo" for i in (1, 2))
    x = x.filter((v1 > 0) & (v2 > 0)).withColumns({"c1": F.pow(v1, F.lit(1.5)), "c2": F.pow(v2, F.lit(1.5))})
    x = x.withColumn("_delta", F.col("m1") / F.sqrt(v1) - F.col("m2") / F.sqrt(v2) - (F.col("o1") / F.sqrt(u1) - F.col("o2") / F.sqrt(u2)))
    x = x.withColumns({"g1": F.col("m3") / F.col("c1"), "g2": -F.col("m4") / F.col("c2"), "g3": -F.col("m1") / (2 * F.col("c1")), "g4": F.col("m2") / (2 * F.col("c2"))})
    dot = lambda c: sum((F.col(f"g{i}") * F.col(f"{c}{i}") for i in range(2, 5)), F.col("g1") * F.col(f"{c}1"))
    square = sum((F.col(f"g{i}") * F.col(f"g{j}") * F.col(f"q{i}{j}") * (1 if i == j else 2) for i, j in pairs[1:]), F.col("g1") * F.col("g1") * F.col("q11"))
    # sum over whole blocks of (g . (S - block d))^2, of which the blocks' variance is made
    shift = F.col("block") * dot("d")
    number = F.floor(F.col("n") / F.col("block"))
    spread = F.greatest(square - 2 * shift * dot("w") + number * shift * shift, F.lit(0.0)) / F.col("block")
    return x.select(*by, "block", "rep", F.try_divide(F.abs("_delta"), F.sqrt(spread / number / F.col("n"))).alias("t_stat"))


def block_sweep(df: DataFrame, by: tuple[str, ...], blocks: tuple[int, ...] = BLOCKS, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """hac_difference with p of the studentised circular block bootstrap for each block length (by, ..., block, p).

    Each replicate's blocks start where counter-based numbers say, so that results depend on nothing but the seed; sums
    over blocks come from prefix sums, replicates are rows. p is (1 + those whose statistic is no smaller) over one more
    than replicates; a replicate that doesn't vary isn't counted. A block longer than the series gives no row. by must
    not be null.
    """
    df = order.settled(df.select(*by, "t", "r1", "r2"))
    base = hac_difference(df, by)
    found = _replicates(df, by, tuple(dict.fromkeys(blocks)), replicates, seed).withColumnRenamed("t_stat", "_t").join(base, list(by))
    kept = [c for c in base.columns if c not in by]
    hits = found.groupBy(*by, "block").agg(*(F.first(c).alias(c) for c in kept), F.count_if(F.col("_t") >= F.abs("t_stat")).alias("_hits"))
    return hits.withColumn("p", (F.col("_hits") + 1) / F.lit(replicates + 1.0)).drop("_hits")


def bootstrap_p(df: DataFrame, by: tuple[str, ...], block: int = 5, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(by, block, p) of one block length."""
    return block_sweep(df, by, (block,), replicates, seed).select(*by, "block", "p")


def compared(returns: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(universe, a, b, t, r1, r2) of pairs of models from (universe, model, t, q), months that both have; one pass."""
    models = sorted({m for p in pairs for m in p})
    month = returns.filter(F.col("model").isin(models)).groupBy("universe", "t").agg(*(F.max(F.when(F.col("model") == m, F.col("q"))).alias(f"_{i}") for i, m in enumerate(models)))
    at = {m: f"_{i}" for i, m in enumerate(models)}
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(at[a]).alias("r1"), F.col(at[b]).alias("r2")) for a, b in pairs))
    return month.select("universe", "t", F.explode(sides).alias("p")).select("universe", "p.a", "p.b", "t", "p.r1", "p.r2").filter("r1 is not null and r2 is not null")
