"""Parquet stores of panels, draws and backtests, partitioned by what readers filter on; a CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRAW_KEYS = ["universe", "model", "setting", "chain"]


def panel_metadata(panel: DataFrame, names: list[str], dropped: list[str] = ()) -> DataFrame:
    """One row a universe: assets, K, T, range, predictor columns, columns dropped."""
    g = panel.groupBy("universe").agg(
        F.array_sort(F.collect_set("asset")).alias("asset_names"),
        F.count_distinct("month").alias("T"),
        F.date_format(F.min("month"), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max("month"), "yyyy-MM-dd").alias("last"),
    )
    text = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return g.select("universe", F.size("asset_names").alias("n_assets"), "asset_names", F.lit(len(names)).alias("K"), "T", F.array("first", "last").alias("date_range"), text(names).alias("predictor_columns"), text(list(dropped)).alias("drop_columns"))


def save_panel(panel: DataFrame, path: str, names: list[str], dropped: list[str] = ()) -> None:
    panel.write.mode("overwrite").partitionBy("universe").parquet(f"{path}/panel")
    panel_metadata(panel, names, dropped).write.mode("overwrite").json(f"{path}/meta")


def load_panel(spark: SparkSession, path: str, universe: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/panel")
    return df if universe is None else df.filter(F.col("universe") == universe)


def load_predictor_names(spark: SparkSession, path: str, universe: str, k: int) -> list[str]:
    """The stored names, or numbered ones where they are missing or not k."""
    try:
        row = spark.read.json(f"{path}/meta").filter(F.col("universe") == universe).first()
    except Exception as e:  # no metadata there
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        row = None
    names = list(row["predictor_columns"]) if row is not None else []
    return names if len(names) == k else [f"x{i}" for i in range(k)]


def save_draws(draws: DataFrame, path: str, absent: list[str] = ()) -> None:
    """Draws (universe, model, setting, chain, draw, field, i, j, value), and the names of fields that the run lacks."""
    draws.write.mode("append").partitionBy(*DRAW_KEYS).parquet(f"{path}/draws")
    meta = draws.select(*DRAW_KEYS).distinct().withColumn("absent", F.array(*map(F.lit, absent)) if absent else F.array().cast("array<string>"))
    meta.write.mode("append").parquet(f"{path}/draws_meta")


def load_draws(spark: SparkSession, path: str, universe: str, model: str, setting: str, chain: int) -> DataFrame:
    return spark.read.parquet(f"{path}/draws").filter((F.col("universe") == universe) & (F.col("model") == model) & (F.col("setting") == setting) & (F.col("chain") == chain))


def absent_fields(spark: SparkSession, path: str, universe: str, model: str, setting: str) -> list[str]:
    rows = spark.read.parquet(f"{path}/draws_meta").filter((F.col("universe") == universe) & (F.col("model") == model) & (F.col("setting") == setting))
    return sorted({x for r in rows.select("absent").distinct().collect() for x in r["absent"]})


def load_chains(spark: SparkSession, path: str, universe: str, model: str, setting: str) -> DataFrame:
    """All chains of a setting; chains are numbers, so 10 follows 9. An unknown setting raises and names the known ones."""
    store = spark.read.parquet(f"{path}/draws").filter((F.col("universe") == universe) & (F.col("model") == model))
    found = store.filter(F.col("setting") == setting).withColumn("chain", F.col("chain").cast("int"))
    if found.isEmpty():
        known = sorted(r["setting"] for r in store.select("setting").distinct().collect())
        raise FileNotFoundError(f"no chains of {setting!r}; there are {', '.join(known) or 'none'}")
    return found


def chain_numbers(chains: DataFrame) -> list[int]:
    return [r["chain"] for r in chains.select("chain").distinct().orderBy("chain").collect()]


def save_backtest(forecasts: DataFrame, path: str) -> None:
    """Forecasts (universe, model, setting, asset, t, t_refit, predicted, realised, benchmark)."""
    forecasts.write.mode("append").partitionBy("universe", "model", "setting").parquet(path)


def load_backtest(spark: SparkSession, path: str, universe: str, model: str, setting: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("universe") == universe) & (F.col("model") == model) & (F.col("setting") == setting))


def save_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)  # result tables of a few rows


def latex_table(df: DataFrame, decimals: int = 3, most: int = 1_000) -> str:
    """Rows of a small result table as LaTeX; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows isn't for print")
    show = lambda x: f"{x:.{decimals}f}" if isinstance(x, float) else "--" if x is None else str(x).replace("_", r"\_")
    body = [" & ".join(show(x) for x in r) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])
