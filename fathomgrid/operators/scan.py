"""Running aggregates of long series in two levels: chunks of a series are tasks of their own, chunk totals are scanned.

A window over a whole series is one task, however long it is. Here rows are shuffled by series and chunk; totals of the
chunks, a row each, are summed over earlier chunks and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps of the order (months of a date, else units) in a chunk.
CHUNK = 1_024
Total = tuple[Column, Callable[[str], Column]]


def chunk(df: DataFrame, order: str, size: int) -> Column:
    """Which chunk a row is in: by months of a date, by units of a number."""
    at = F.year(order) * 12 + F.month(order) if df.schema[order].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(order).cast("long")
    return F.floor(at / size).cast("long")


def scanned(df: DataFrame, keys: tuple[str, ...], order: str, totals: dict[str, Total], size: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """df with each total over the earlier chunks of its series (_name; null in the first) and over the series (_all_name).

    totals has an aggregate of a chunk's rows and how chunks' values are combined (F.sum, F.min, F.max). Also returns the
    window over a row's own chunk in order, for what has to be added. Series whose keys are null are series like others.
    """
    parts = df.withColumn("_chunk", chunk(df, order, size))
    each = parts.groupBy(*keys, "_chunk").agg(*(total.alias(f"_{name}") for name, (total, _) in totals.items()))
    series = W.partitionBy(*keys)
    before = series.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    found = {f"_all_{name}": combine(f"_{name}").over(series) for name, (_, combine) in totals.items()} | {f"_{name}": combine(f"_{name}").over(before) for name, (_, combine) in totals.items()}
    sums = each.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_chunk").alias("_at"), *(c.alias(n) for n, c in found.items()))
    same = F.col("_chunk").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = parts.join(sums, same).drop("_at", *(f"_key_{k}" for k in keys))
    return joined, W.partitionBy(*keys, "_chunk").orderBy(order)


def without(df: DataFrame, totals: dict[str, Total]) -> DataFrame:
    return df.drop("_chunk", *(f"_{n}" for n in totals), *(f"_all_{n}" for n in totals))


def numbered(df: DataFrame, keys: tuple[str, ...], order: str, name: str, size: int = CHUNK, count: str | None = None) -> DataFrame:
    """name: a row's place in its series, from 0; count: the rows of its series, if named. Ties of order take any order."""
    totals = {"n": (F.count(F.lit(1)), F.sum)}
    rows, own = scanned(df, keys, order, totals, size)
    rows = rows.withColumn(name, F.coalesce(F.col("_n"), F.lit(0)) + F.row_number().over(own) - 1)
    return without(rows.withColumn(count, F.col("_all_n")) if count else rows, totals)


def running_sum(df: DataFrame, value: Column, keys: tuple[str, ...], order: str, name: str, size: int = CHUNK) -> DataFrame:
    """name: sum of value over the series' rows so far, this one included; null while there is none."""
    df = df.withColumn("_x", value)
    totals = {"s": (F.sum("_x"), F.sum)}
    rows, own = scanned(df, keys, order, totals, size)
    here = F.sum("_x").over(own.rowsBetween(W.unboundedPreceding, 0))
    return without(rows.withColumn("_h", here).withColumn(name, F.coalesce(F.col("_s") + F.col("_h"), "_s", "_h")).drop("_x", "_h"), totals)


def mean_before(df: DataFrame, value: str, keys: tuple[str, ...], order: str, name: str, size: int = CHUNK) -> DataFrame:
    """name: mean of value over the series' rows strictly before; null without any."""
    totals = {"n": (F.count(value), F.sum), "s": (F.sum(value), F.sum)}
    rows, own = scanned(df, keys, order, totals, size)
    before, zero = own.rowsBetween(W.unboundedPreceding, -1), F.lit(0.0)
    total = F.coalesce(F.col("_s"), zero) + F.coalesce(F.sum(value).over(before), zero)
    return without(rows.withColumn(name, F.try_divide(total, F.coalesce(F.col("_n"), F.lit(0)) + F.count(value).over(before))), totals)


def zscores(df: DataFrame, columns: list[str], keys: tuple[str, ...], order: str, size: int = CHUNK) -> DataFrame:
    """(x - mean) / sd of each column over the series' rows so far, this one included; null where these don't differ.

    Moments of earlier chunks and of the own chunk are merged by their differences (Chan et al., 1983), so that nothing
    large cancels; the least and greatest value tell a constant series.
    """
    totals: dict[str, Total] = {}
    for i, c in enumerate(f"`{c}`" for c in columns):
        mean = f"coalesce(avg({c}), 0.0D)"
        each = {"n": f"count({c})", "s": f"count({c}) * {mean}", "q": f"count({c}) * (coalesce(var_pop({c}), 0.0D) + {mean} * {mean})", "lo": f"min({c})", "hi": f"max({c})"}
        totals |= {f"{k}{i}": (F.expr(x), {"lo": F.min, "hi": F.max}.get(k, F.sum)) for k, x in each.items()}
    rows, _ = scanned(df, keys, order, totals, size)
    w = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in (*keys, '_chunk'))} ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    own = {f"_own{i}": F.expr(f"struct(count(`{c}`) {w} AS n, coalesce(avg(`{c}`) {w}, 0.0D) AS m, coalesce(var_pop(`{c}`) {w}, 0.0D) AS v, min(`{c}`) {w} AS lo, max(`{c}`) {w} AS hi)") for i, c in enumerate(columns)}
    before = {f"_old{i}": F.expr(f"struct(coalesce(_n{i}, 0L) AS n, coalesce(try_divide(_s{i}, _n{i}), 0.0D) AS m, coalesce(greatest(_q{i} - _s{i} * try_divide(_s{i}, _n{i}), 0.0D), 0.0D) AS s)") for i in range(len(columns))}
    rows = rows.withColumns(own | before)
    out = {}
    for i, c in enumerate(columns):
        a, b = f"_old{i}", f"_own{i}"
        n = f"({a}.n + {b}.n)"
        square = f"({a}.s + {b}.n * {b}.v + coalesce(try_divide(({b}.m - {a}.m) * ({b}.m - {a}.m) * {a}.n * {b}.n, {n}), 0.0D))"
        mean = f"try_divide({a}.n * {a}.m + {b}.n * {b}.m, {n})"
        out[c] = F.expr(f"CASE WHEN least(_lo{i}, {b}.lo) < greatest(_hi{i}, {b}.hi) THEN try_divide(`{c}` - {mean}, sqrt(try_divide({square}, {n} - 1))) END")
    return without(rows.withColumns(out).drop(*own, *before), totals)
