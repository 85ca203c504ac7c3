"""Point-in-time features: lags, full trailing windows, expanding z-scores, the lead response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

KEYS = ("universe", "asset")
OWN = ["ret_lag1", "ret_lag3", "ret_lag6", "ret_lag12", "mean12", "vol12", "skew12", "mom12"]


def by_asset(keys: tuple[str, ...] = KEYS) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("month")


def full(value: Column, source: str, frame: WindowSpec, n: int) -> Column:
    """value where the frame holds n values of source, else null."""
    return F.when(F.count(source).over(frame) == n, value)


def own_history(df: DataFrame, value: str = "ret", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lags 1, 3, 6, 12 (positions), trailing mean, sd and adjusted skewness of 12, product of 11 lagged growth factors."""
    w = by_asset(keys)
    year = w.rowsBetween(-11, 0)
    n = 12.0
    adjusted = F.skewness(value).over(year) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))
    df = df.withColumns({f"ret_lag{k}": F.lag(value, k).over(w) for k in (1, 3, 6, 12)})
    eleven = w.rowsBetween(-10, 0)
    return df.withColumns(
        {
            "mean12": full(F.avg(value).over(year), value, year, 12),
            "vol12": full(F.stddev_samp(value).over(year), value, year, 12),
            "skew12": full(F.when(F.stddev_samp(value).over(year) > 0, adjusted), value, year, 12),
            "mom12": full(F.product(F.lit(1.0) + F.col("ret_lag1")).over(eleven) - 1.0, "ret_lag1", eleven, 11),
        }
    )


def expanding_zscore(df: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(x - mean) / sd over all rows so far, this one included; null for the first and where sd is 0."""
    return scan.zscores(df, columns, keys, "month")


def lead_response(df: DataFrame, value: str = "ret", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """r_next: next month's value. Rows dated t so carry what is known at t and predict t + 1; nothing lags it again."""
    return df.withColumn("r_next", F.lead(value).over(by_asset(keys)))


def numbered(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(by_asset(keys)) - 1).cast("int"))
