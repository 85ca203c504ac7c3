"""Least squares of every refit of an expanding window, in the JVM: sums of products by refit, solved in array functions.

No panel is gathered: an asset's rows meet only their own products' sums, so universes of any size fit. Row vectors f and
responses r_next make the products z_i z_j of z = (f, r_next); their sums over the rows before a refit are X'X, X'y and
y'y, packed as a lower triangle by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions.scalar import dot

from . import backtest as B

KEYS = ("universe", "asset")
#: A pivot below this share of its diagonal element means that columns depend on each other.
SINGULAR = 1e-12


def _at(i: Column | int, j: Column | int) -> Column:
    """Position (from 0) of element (i, j), j <= i, of a packed lower triangle."""
    i = F.lit(i) if isinstance(i, int) else i
    return (i * (i + 1) / 2).cast("int") + j


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cholesky(a: Column, k: int) -> Column:
    """Packed factor L of a packed symmetric matrix of order k, a = L L'; null elements from a pivot on that isn't positive."""
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(i + 1)))

    def add(done: Column, p: Column) -> Column:
        i, j = p["i"], p["j"]
        here = F.get(a, _at(i, j))
        rest = here - _product(F.slice(done, _at(i, 0) + 1, j), F.slice(done, _at(j, 0) + 1, j))
        pivot = F.when(rest > SINGULAR * here, F.sqrt(rest))
        return F.concat(done, F.array(F.when(i == j, pivot).otherwise(F.try_divide(rest, F.get(done, _at(j, j))))))

    return F.aggregate(places, F.array().cast("array<double>"), add)


def solved(factor: Column, b: Column, k: int) -> Column:
    """x of L L' x = b, for a packed factor; null if that has a null element."""
    rows = F.array(*map(F.lit, range(k)))

    def ahead(done: Column, i: Column) -> Column:
        rest = F.get(b, i) - _product(F.slice(factor, _at(i, 0) + 1, i), done)
        return F.concat(done, F.array(F.try_divide(rest, F.get(factor, _at(i, i)))))

    y = F.aggregate(rows, F.array().cast("array<double>"), ahead)

    def back(done: Column, i: Column) -> Column:
        column = F.transform(F.filter(rows, lambda r: r > i), lambda r: F.get(factor, _at(r, i)))
        return F.concat(F.array(F.try_divide(F.get(y, i) - _product(column, done), F.get(factor, _at(i, i)))), done)

    x = F.aggregate(F.reverse(rows), F.array().cast("array<double>"), back)
    return F.when(~F.exists(factor, lambda v: v.isNull()), x)


def products(rows: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """(by, gram, n): packed sums of products of z = (f, r_next) and the number of rows, summed within tasks first."""
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k + 1) for j in range(i + 1)))
    z = rows.select(*by, F.concat("f", F.array(F.col("r_next").cast("double"))).alias("z"))
    each = z.select(*by, F.posexplode(F.transform(places, lambda p: F.get("z", p["i"]) * F.get("z", p["j"]))).alias("slot", "x"))
    sums = each.groupBy(*by, "slot").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "x"))), lambda s: s["x"]).alias("gram"), F.first("n").alias("n"))


def _split(gram: Column, k: int, penalty: float) -> tuple[Column, Column, Column]:
    """Packed X'X with the penalty on all diagonal elements but the first, X'y and y'y."""
    diagonal = F.array(*(F.lit(0.0 if i != j or not i else float(penalty)) for i in range(k) for j in range(i + 1)))
    size = k * (k + 1) // 2
    return F.zip_with(F.slice(gram, 1, size), diagonal, lambda x, d: x + d), F.slice(gram, size + 1, k), F.element_at(gram, size + k + 1)


def width(panel: DataFrame) -> int:
    """Number of predictors; all rows must have as many."""
    found = panel.agg(F.min(F.size("f")).alias("least"), F.max(F.size("f")).alias("k")).first()
    if found["least"] != found["k"]:
        raise ValueError(f"rows have {found['least']} to {found['k']} predictors")
    return found["k"] or 0


def fits(panel: DataFrame, k: int, schedules: list[tuple[int, int]], penalty: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Coefficients of every refit that has rows to forecast: (keys, start, refit_every, t_refit, n, b array).

    A row belongs to the step between two refits; the sums of the steps before a refit are a window over an asset's few
    steps. b is null where the rows before a refit don't determine it (too few, or dependent columns), and a refit
    without earlier rows has no fit. All schedules (start, refit_every) share one pass.
    """
    plans = F.explode(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("refit_every")) for s, e in schedules)))
    rows = panel.filter("r_next is not null").withColumn("_s", plans).select("*", "_s.start", "_s.refit_every")
    step = F.greatest(F.floor((F.col("t") - F.col("start")) / F.col("refit_every")) + 1, F.lit(0)).cast("int")
    by = (*keys, "start", "refit_every")
    steps = products(rows.withColumn("step", step), (*by, "step"), k)
    before = W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    size = (k + 1) * (k + 2) // 2
    none = F.array_repeat(F.lit(0.0), size)
    earlier = steps.withColumn("n", F.sum("n").over(before)).withColumn("gram", F.aggregate(F.collect_list("gram").over(before), none, lambda a, g: F.zip_with(a, g, lambda x, y: x + y)))
    refits = earlier.filter("step > 0 AND n > 0").withColumn("t_refit", (F.col("start") + (F.col("step") - 1) * F.col("refit_every")).cast("int"))
    xx, xy, _ = _split(F.col("gram"), k, penalty)
    factors = refits.withColumn("_xy", xy).withColumn("_l", cholesky(xx, k))
    return factors.select(*by, "t_refit", "n", solved(F.col("_l"), F.col("_xy"), k).alias("b"))


def backtests(panel: DataFrame, schedules: list[tuple[int, int]], penalty: float = 0.0, keys: tuple[str, ...] = KEYS, k: int | None = None) -> DataFrame:
    """Forecasts of every row from a schedule's start on by the fit of its latest refit, with the mean of earlier rows.

    Returns (keys, month if there is one, start, refit_every, t, t_refit, predicted, realised, benchmark); predicted is
    null where the refit has no coefficients. k is the number of predictors, counted if it isn't given.
    """
    k = k or width(panel)
    found = fits(panel, k, schedules, penalty, keys)
    plans = F.explode(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("refit_every")) for s, e in schedules)))
    rows = B.expanding_benchmark(panel.filter("r_next is not null"), keys=keys).withColumn("_s", plans).select("*", "_s.start", "_s.refit_every").filter("t >= start")
    rows = rows.withColumn("t_refit", (F.col("start") + F.floor((F.col("t") - F.col("start")) / F.col("refit_every")) * F.col("refit_every")).cast("int"))
    names = [c for c in (*keys, "month", "start", "refit_every", "t", "t_refit") if c in rows.columns]
    joined = rows.join(found.drop("n"), [*keys, "start", "refit_every", "t_refit"])
    return joined.select(*names, dot(F.col("f"), F.col("b")).alias("predicted"), F.col("r_next").alias("realised"), "benchmark")


def expanding_window(panel: DataFrame, start: int = B.START, every: int = B.REFIT_EVERY, penalty: float = 0.0, keys: tuple[str, ...] = KEYS, k: int | None = None) -> DataFrame:
    """Backtest of one schedule."""
    return backtests(panel, [(start, every)], penalty, keys, k).drop("start", "refit_every")


def pooled_scale(panel: DataFrame, by: tuple[str, ...] = ("universe",), asset: str = "asset", k: int | None = None) -> DataFrame:
    """Residual sd of least squares by asset over each group's rows, with sum(n - k) degrees of freedom: (by, sd).

    An asset whose coefficients aren't determined makes its group's sd null.
    """
    k = k or width(panel)
    sums = products(panel.filter("r_next is not null"), (*by, asset), k)
    xx, xy, yy = _split(F.col("gram"), k, 0.0)
    b = sums.withColumn("_xy", xy).withColumn("_yy", yy).withColumn("_l", cholesky(xx, k)).withColumn("_b", solved(F.col("_l"), F.col("_xy"), k))
    errors = b.withColumn("_sse", F.when(F.col("n") > k, F.greatest(F.col("_yy") - _product(F.col("_b"), F.col("_xy")), F.lit(0.0))))
    whole = F.when(F.count("_sse") == F.count(F.lit(1)), F.sum("_sse"))
    return errors.groupBy(*by).agg(F.sqrt(F.try_divide(whole, F.sum(F.col("n") - k))).alias("sd"))
