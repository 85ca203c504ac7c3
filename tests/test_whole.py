"""Queries and operators do the whole of their job: all universes, all budgets, all rows."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from fathomgrid.operators import backtest as B
from fathomgrid.plans import registry
from fathomgrid.plans import testpanel as T

SF = "/root/testdata/sf0.01"
UNIVERSES = {"type", "brand", "nation"}
ALL = registry.all_queries()


def test_ridge_backtest_covers_every_universe(spark):
    rows = ALL["ridge_backtest"].spark(spark, SF).groupBy("universe").agg(F.countDistinct("asset").alias("assets"), F.min("t").alias("t")).collect()
    assert {(r["universe"], r["assets"], r["t"]) for r in rows} == {("type", 6, 24), ("brand", 25, 24), ("nation", 25, 24)}


def test_short_universe_is_left_out(spark):
    found = ALL["ridge_backtest"].spark(spark, "/root/testdata/sf0.001").select("universe").distinct().collect()
    assert {r["universe"] for r in found} == {"type", "nation"}  # the brands have too few months


def test_gibbs_backtest_covers_every_universe_with_the_whole_budget(spark, monkeypatch):
    used, fitted = [], registry.fitted
    monkeypatch.setattr(registry, "fitted", lambda s, d, fit, **k: used.append(fit.settings) or fitted(s, d, fit, **k))
    rows = ALL["gibbs_backtest"].spark(spark, SF).groupBy("universe").agg(F.countDistinct("asset").alias("assets"), F.min("t").alias("t")).collect()
    # 25 assets have no covariance over 24 months
    assert {(r["universe"], r["assets"], r["t"]) for r in rows} == {("type", 6, 24), ("brand", 25, 36), ("nation", 25, 36)}
    assert (used[0]["draws"], used[0]["burn"]) == (500, 100)


@pytest.mark.parametrize("name", ["gram_blocks_all", "training_rows_all", "restricted_months_all", "sentinel_recode_all"])
def test_whole_query_covers_every_universe(spark, name):
    rows = ALL[name].spark(spark, SF).toPandas()
    assert set(rows["universe"]) == UNIVERSES
    same(rows, connect(SF).execute(ALL[name].oracle()).df())
    if name == "training_rows_all":  # 81 and 80 rows to an asset
        assert {u: sorted(g) for u, g in rows.groupby("universe")["t_refit"]} == {u: [36, 48, 60, 72] for u in UNIVERSES}


def test_lookahead_check_sees_a_leak_in_any_universe(spark, monkeypatch):
    forecasts = B.ar1_forecasts

    def leaking(df, *a):
        last = df.groupBy("universe", "asset").agg(F.max_by("r_next", "t").alias("_last"))
        out = forecasts(df, *a).join(last, ["universe", "asset"])
        return out.withColumn("predicted", F.when(F.col("universe") == "nation", F.col("predicted") + F.col("_last")).otherwise(F.col("predicted"))).drop("_last")

    monkeypatch.setattr(registry.B, "ar1_forecasts", leaking)
    assert ALL["lookahead_check"].spark(spark, SF).first()["before"] > 0


def test_training_rows_follow_a_longer_panel(spark, monkeypatch):
    p = spark.range(0, 100).selectExpr("'u' AS universe", "'a' AS asset", "cast(id AS int) AS t", "1.0D AS r_next")
    monkeypatch.setattr(registry.T, "responses", lambda *a: p)
    rows = ALL["training_rows_all"].spark(spark, "").orderBy("t_refit").collect()
    assert [(r["t_refit"], r["n"]) for r in rows] == [(t, t) for t in (36, 48, 60, 72, 84, 96)]


def test_training_rows_keep_every_refit(spark):
    p = spark.createDataFrame([("u", "a", 0, 1.0)], "universe string, asset string, t int, r_next double")
    refits = spark.range(1, 10_051).selectExpr("cast(id AS int) AS t_refit")
    assert B.training_rows(p, refits).count() == 10_050
    assert B.training_rows(p, refits.selectExpr("'v' AS universe", "t_refit")).count() == 0


def test_sharpe_bootstrap_has_every_block_series_and_replicate(spark):
    rows = ALL["sharpe_bootstrap"].spark(spark, SF).toPandas()
    assert {(r.universe, r.block) for r in rows.itertuples()} == {(u, b) for u in UNIVERSES | {"stacked"} for b in (2, 5, 10, 20)}
    assert len(rows) == 16 and all(abs(p * 5000 - round(p * 5000)) < 0.01 for p in rows["p"])
    assert any(abs(p * 500 - round(p * 500)) > 0.01 for p in rows["p"])  # steps of 1/5000, not 1/500


def test_statistic_ranges_all_has_every_statistic(spark):
    rows = ALL["statistic_ranges_all"].spark(spark, SF).toPandas()
    assert {(r.universe, r.statistic) for r in rows.itertuples()} == {(u, x) for u in UNIVERSES for x in ("mean_pct", "sd_pct", "sharpe", "ar1")}
    same(rows, connect(SF).execute(ALL["statistic_ranges_all"].oracle()).df())
