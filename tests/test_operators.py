import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import scalar as S
from fathomgrid.models import fitters
from fathomgrid.models.simulate import simulate
from fathomgrid.operators import backtest as B
from fathomgrid.operators import draws as M
from fathomgrid.operators import evaluation as E
from fathomgrid.operators import features as X
from fathomgrid.operators import panel as P
from fathomgrid.operators import sharpe_test as L


def test_normal_functions(spark):
    ps = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", S.normal_quantile(F.col("p")).alias("z")).select("p", "z", S.normal_cdf(F.col("z")).alias("back")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-7, abs=1e-8)
        assert r["back"] == pytest.approx(r["p"], abs=2e-7)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = [("u", a, dt.date(2000 + m // 12, m % 12 + 1, 1), float(x)) for a in ("a", "b", "c") for m, x in enumerate(rng.normal(0, 0.1, 60))]
    return spark.createDataFrame(rows, "universe string, asset string, month date, ret double")


def test_own_history_equals_pandas(spark, panel):
    got = X.expanding_zscore(X.own_history(panel), ["vol12"]).withColumn("z", F.col("vol12")).toPandas()
    raw = X.own_history(panel).toPandas().sort_values(["asset", "month"])
    for _, g in raw.groupby("asset"):
        r = g["ret"]
        np.testing.assert_allclose(g["ret_lag6"], r.shift(6))
        np.testing.assert_allclose(g["mean12"], r.rolling(12).mean(), atol=1e-12)
        np.testing.assert_allclose(g["vol12"], r.rolling(12).std(), atol=1e-12)
        np.testing.assert_allclose(g["skew12"], r.rolling(12).skew(), atol=1e-9)
        np.testing.assert_allclose(g["mom12"], (1 + r.shift(1)).rolling(11).apply(np.prod) - 1, atol=1e-12)
        v = g["vol12"]
        np.testing.assert_allclose(got[got.asset == g.asset.iloc[0]].sort_values("month")["z"], (v - v.expanding().mean()) / v.expanding().std(), atol=1e-9)


def test_listwise_and_stabilised(spark, panel):
    holed = panel.withColumn("ret", F.when((F.col("asset") == "a") & (F.col("month") == "2001-03-01"), None).otherwise(F.col("ret")))
    assert P.listwise(holed).select("month").distinct().count() == 59
    assert P.listwise(holed, drop=["a"]).count() == 120
    assert P.stabilised(panel, 30).count() == 90
    a, b = P.common_range(panel.filter("month >= '2001-01-01'"), panel.filter("month < '2003-01-01'"))
    assert a.select("month").distinct().count() == b.select("month").distinct().count() == 24


def small_panel(spark, t=60, n=4, k=3):
    s = simulate(n, k, t, seed=2)
    rows = [("u", f"a{i}", m, s.f[i, m].tolist(), float(s.r[i, m])) for i in range(n) for m in range(t)]
    return s, spark.createDataFrame(rows, "universe string, asset string, t int, f array<double>, r_next double")


@pytest.mark.parametrize("fit", [fitters.ols(), fitters.ridge(2.0), fitters.fitter("gaussian", draws=30, burn=10), fitters.fitter("lasso", draws=30, burn=10)])
def test_no_lookahead(spark, fit):
    _, p = small_panel(spark)
    B.assert_no_lookahead(fit, p, 40, 30, 10)


def test_lookahead_is_found(spark):
    s, p = small_panel(spark)
    r = s.r.copy()

    def peeking(run, q):  # its coefficients come from all months
        b = fitters.ols()(np.array(q.select("r_next").orderBy("asset", "t").toPandas()["r_next"]).reshape(r.shape), s.f)
        fits = spark.createDataFrame([(t, f"a{i}", b[i].tolist()) for t in (30, 40, 50) for i in range(4)], "t_refit int, asset string, b array<double>")
        return B.forecasts(q, fits, 30, 10)

    found = B.lookahead(lambda q: peeking(None, q), p, 40, 10).first()
    assert found["before"] > 0


def test_expanding_window_equals_loop(spark):
    s, p = small_panel(spark)
    got = B.expanding_window(p, fitters.ols(), 30, 12).toPandas().set_index(["asset", "t"])
    assert len(got) == 4 * 30
    for t in (30, 41, 42, 59):
        t0 = 30 + (t - 30) // 12 * 12
        b = fitters.ols()(s.r[:, :t0], s.f[:, :t0])
        for i in range(4):
            row = got.loc[(f"a{i}", t)]
            assert row["predicted"] == pytest.approx(s.f[i, t] @ b[i]) and row["t_refit"] == t0
            assert row["benchmark"] == pytest.approx(s.r[i, :t].mean())
    with pytest.raises(ValueError):
        B.expanding_window(p, fitters.ols(), 60, 12)


def test_schedules_and_intervals(spark):
    _, p = small_panel(spark)
    both = B.refit_schedules(p, fitters.ols(), [(30, 12), (40, 5)])
    assert {(r["start"], r["refit_every"]): r["count"] for r in both.groupBy("start", "refit_every").count().collect()} == {(30, 12): 120, (40, 5): 80}
    iv = B.intervals(p, fitters.interval_fitter("gaussian", draws=120, burn=20), 48, 12).toPandas()
    assert len(iv) == 48 and (iv.lo_full <= iv.lo_coef).mean() > 0.95 and (iv.hi_full > iv.hi_coef).mean() > 0.95
    again = B.intervals(p.repartition(7), fitters.interval_fitter("gaussian", draws=120, burn=20), 48, 12).toPandas()
    pd.testing.assert_frame_equal(iv.sort_values(["t", "asset"]).reset_index(drop=True), again.sort_values(["t", "asset"]).reset_index(drop=True))
    c = E.coverage(B.intervals(p, fitters.interval_fitter("gaussian", draws=120, burn=20), 36, 12), ("t_refit",)).toPandas()
    assert c.cover_full.mean() > 0.75


def test_degenerate_weights_and_sharpe(spark):
    df = spark.createDataFrame([("u", a, 0, 0.3, 0.1) for a in "abc"] + [("u", a, 1, x, 0.1) for a, x in zip("abc", (0.1, 0.2, 0.6))], "universe string, asset string, t int, predicted double, realised double")
    w = E.weights(df).orderBy("t", "asset").toPandas()
    assert w.w[:3].tolist() == [0, 0, 0] and w.w[3:].abs().sum() == pytest.approx(1)
    flat = spark.createDataFrame([("u", t, 0.01) for t in range(9)], "universe string, t int, q double")
    assert E.sharpe(flat).first()["sharpe"] is None
    none = spark.createDataFrame([("u", "a", 1, 1.0, 2.0, 2.0)], "universe string, asset string, t int, predicted double, realised double, benchmark double")
    assert E.oos_r2(none).first()["r2"] is None


def test_loss_shares_add_up(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("u", a, t, *map(float, rng.normal(size=3))) for a in "abcd" for t in range(30)], "universe string, asset string, t int, predicted double, realised double, benchmark double")
    d, r2 = E.loss_decomposition(df).first(), E.oos_r2(df).first()["r2"]
    assert sum(d[1:]) == pytest.approx(-r2)


def test_forecast_test_sizes(spark):
    rng = np.random.default_rng(0)
    reps = []
    for rep in range(120):
        common = rng.normal(size=(60, 1))
        r = common + rng.normal(size=(60, 4))
        reps += [(str(rep), f"a{i}", t, float(r[t, i]), float(x), float(y)) for t in range(60) for i in range(4) for x, y in [(rng.normal(0, 0.3), rng.normal(0, 0.3))]]
    df = spark.createDataFrame(reps, "universe string, asset string, t int, realised double, a double, b double")
    p = E.diebold_mariano(df, "a", "b").toPandas().p
    assert len(p) == 120 and 0.0 <= (p < 0.05).mean() < 0.14


def test_newey_west_of_ar1(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(2000)
    for t in range(1, 2000):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([("u", t, float(v)) for t, v in enumerate(x)], "universe string, t int, q double")
    lrv = E.long_run_variance(df, "q").first()["lrv"]
    assert x.var() < lrv < 1 / 0.09 * 1.3


def ratio_moments(x):
    m, g = x.mean(axis=0), (x * x).mean(axis=0)
    v = g - m * m
    s = v**1.5
    return m[0] / np.sqrt(v[0]) - m[1] / np.sqrt(v[1]), np.array([g[0] / s[0], -g[1] / s[1], -m[0] / (2 * s[0]), m[1] / (2 * s[1])])


def test_bootstrap_replicates(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.2, 1, (43, 2)) + 5 * rng.normal(size=(43, 1))
    df = spark.createDataFrame([("u", t, float(a), float(b)) for t, (a, b) in enumerate(x)], "universe string, t int, r1 double, r2 double")
    got = L._replicates(df, ("universe",), (1, 5, 43, 50), 40, 7).toPandas()
    assert sorted(set(got["block"])) == [1, 5, 43]  # the last is longer than the series
    cell = spark.range(43).select(*(L.block_start(7, F.lit(b), F.lit(r), F.col("id"), F.lit(43)).alias(f"s{b}_{r}") for b in (1, 5, 43) for r in (0, 39))).toPandas()
    delta, _ = ratio_moments(x)
    for b in (1, 5):  # one block of 43 has the whole series in another order, and no error
        for r in (0, 39):
            at = np.concatenate([(s + np.arange(b)) % 43 for s in cell[f"s{b}_{r}"][: -(-43 // b)]])[:43]
            d, gradient = ratio_moments(x[at])
            y = np.hstack([x[at], x[at] ** 2])
            sums = ((y - y.mean(axis=0)) @ gradient)[: 43 // b * b].reshape(-1, b).sum(axis=1)
            want = abs(d - delta) / np.sqrt((sums @ sums) / b / len(sums) / 43)
            assert got.query("block == @b and rep == @r")["t_stat"].item() == pytest.approx(want, rel=1e-6)
    starts = spark.range(100_000).select(L.block_start(0, F.lit(5), F.col("id"), F.lit(3), F.lit(10)).alias("s")).groupBy("s").count().toPandas()
    assert len(starts) == 10 and starts["count"].between(9_500, 10_500).all()


def test_sharpe_difference(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.05, 1, (200, 2)) + rng.normal(size=(200, 1))
    df = spark.createDataFrame([("u", t, float(a), float(b)) for t, (a, b) in enumerate(x)], "universe string, t int, r1 double, r2 double")
    row = L.hac_difference(df, ("universe",)).first()
    delta, gradient = ratio_moments(x)
    y = np.hstack([x, x * x])
    z = (y - y.mean(axis=0)) @ gradient
    psi = sum((1 if k == 0 else 2 * (1 - k / 5)) * (z[k:] @ z[: 200 - k]) / 200 for k in range(5))
    assert row["lags"] == 4 and row["delta"] == pytest.approx(delta) and row["se"] == pytest.approx(np.sqrt(psi / 200))
    p = L.bootstrap_p(df, ("universe",), 5, 300).first()["p"]
    assert 0.2 < p <= 1 and p == L.bootstrap_p(df.repartition(3), ("universe",), 5, 300).first()["p"]
    better = df.withColumn("r1", F.col("r1") + 1.5)
    assert L.bootstrap_p(better, ("universe",), 5, 200).first()["p"] < 0.02


def draws_of(spark, x):
    rows = [("x", 0, 0, c, d, float(v)) for c, chain in enumerate(x) for d, v in enumerate(chain)]
    return spark.createDataFrame(rows, "field string, i int, j int, chain int, draw int, value double")


def ar1(rng, rho, shape):
    e = rng.normal(size=shape)
    for t in range(1, shape[1]):
        e[:, t] = rho * e[:, t - 1] + np.sqrt(1 - rho * rho) * e[:, t]
    return e


def test_rhat(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 500))
    assert M.rank_rhat(draws_of(spark, x)).first()["rhat"] == pytest.approx(1.0, abs=0.01)
    shifted = x + np.array([[0], [0], [0], [1.5]])
    assert M.rank_rhat(draws_of(spark, shifted)).first()["rhat"] > 1.1
    scaled = x * np.array([[1], [1], [1], [4.0]])
    row = M.rank_rhat(draws_of(spark, scaled)).first()
    assert row["tail"] > 1.1 and row["rhat"] == row["tail"]
    assert M.rank_rhat(draws_of(spark, x + np.linspace(0, 3, 500))).first()["rhat"] > 1.1
    assert np.isfinite(M.rank_rhat(draws_of(spark, rng.standard_cauchy((4, 500)))).first()["rhat"])
    assert M.rank_rhat(draws_of(spark, np.ones((4, 50)))).first()["rhat"] is None


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.9])
def test_effective_size(rho):
    x = ar1(np.random.default_rng(7), rho, (4, 10000))
    assert M.effective_size(x) == pytest.approx(40000 * (1 - rho) / (1 + rho), rel=0.2)
    assert np.isnan(M.effective_size(np.ones((4, 100)))) and np.isnan(M.effective_size(x[:, :6]))


def test_size_of_one_chain():
    x = ar1(np.random.default_rng(11), 0.6, (1, 20_000))[0]
    assert M.single_effective_size(x) == pytest.approx(20_000 * 0.4 / 1.6, rel=0.2)
    assert M.single_effective_size(np.ones(50)) == 50.0
    x = x[:400]
    c, rho = x - x.mean(), []
    for k in range(1, 399):  # the rule as stated, lag by lag
        rho.append(c[k:] @ c[:-k] / (c @ c))
        if k % 2 == 0 and rho[-1] + rho[-2] < 0:
            break
    assert M.single_effective_size(x) == pytest.approx(400 / max(1, 1 + 2 * sum(rho[:-2])))


def test_deviation_variances(spark):
    df = spark.createDataFrame([(c, 0, 0, float(t), float(v)) for c, rows in enumerate([[(1, 2), (3, 4)], [(5, 8)]]) for t, v in rows], "chain int, i int, j int, tau double, lam double")
    assert M.deviation_variance(df).first()["variance"] == pytest.approx((3.5 * 5.5) ** 2)
    values = df.withColumn("value", F.col("lam"))
    assert M.gaussian_deviation_variance(values).first()["variance"] == pytest.approx(5.5)
    assert M.lasso_deviation_variance(values, 2.0).first()["variance"] == pytest.approx(22.0)


def test_budget_validation_is_the_formula(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6, 40))
    ref = x.mean(axis=1) + rng.normal(0, 0.3, 6)
    short = spark.createDataFrame([("B", 0, j, 0, d, float(v)) for j, row in enumerate(x) for d, v in enumerate(row)], "field string, i int, j int, chain int, draw int, value double")
    got = M.budget_validation(short, spark.createDataFrame([("B", 0, j, float(v)) for j, v in enumerate(ref)], "field string, i int, j int, mean double"), 500.0).first()
    z = np.abs(x.mean(axis=1) - ref) / (x.std(axis=1) * np.sqrt(1 / 40 + 1 / 500))
    assert got["max_z"] == pytest.approx(z.max()) and got["median_z"] == pytest.approx(np.median(z)) and got["within_3"] == pytest.approx((z < 3).mean())
    assert got["corr"] == pytest.approx(np.corrcoef(x.mean(axis=1), ref)[0, 1])


def test_coefficients_show_lookahead(spark):
    s, p = small_panel(spark)
    peek = lambda q: spark.createDataFrame([(t, "a0", [float(q.agg(F.sum("r_next")).first()[0])]) for t in (30, 40, 50)], "t_refit int, asset string, b array<double>")
    assert B.lookahead_coefficients(peek, p, 40).first()["before"] > 0
    fair = B.lookahead_coefficients(lambda q: B.coefficients(q, fitters.ols(), 30, 10), p, 40).first()
    assert fair["before"] == 0 and fair["after"] > 0


def test_divergence_positions_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x, bad = rng.integers(0, 40, 500) / 7.0, rng.random(500) < 0.1
    df = spark.createDataFrame([(float(v), bool(d)) for v, d in zip(x, bad)], "value double, diverging boolean")
    got = sorted((r["x"], r["position"]) for r in M.divergence_positions(df, "value").collect())
    np.testing.assert_allclose(got, sorted((v, (x[~bad] < v).mean()) for v in x[bad]))


def test_diagnosed(spark):
    d = M.diagnosed(draws_of(spark, ar1(np.random.default_rng(2), 0.5, (4, 1000))))
    r = d.first()
    assert r["rhat"] < 1.02 and 800 < r["ess_bulk"] < 2000 and r["ess_tail"] > 300
    assert M.diagnosis_summary(d).first()["n"] == 1
    a = draws_of(spark, ar1(np.random.default_rng(3), 0.5, (4, 500)))
    assert M.runs_agree(a, a).first()["z"] == 0
