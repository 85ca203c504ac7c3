"""Long series, huge groups and every refit's least squares, against NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import backtest as B
from fathomgrid.operators import descriptive as D
from fathomgrid.operators import draws as M
from fathomgrid.operators import features as X
from fathomgrid.operators import least_squares as R
from fathomgrid.operators import order, scan, sizes


def series(n=1_000, seed=0):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"universe": "u", "asset": ["hot"] * (n - 60) + ["small"] * 40 + ["flat"] * 20, "x": rng.standard_normal(n) * 0.01 + 5})
    df["t"] = df.groupby("asset").cumcount().astype(int)
    df.loc[df["asset"] == "flat", "x"] = 0.1
    df.loc[rng.choice(n - 60, 30), "x"] = np.nan
    return df


def frame(spark, df):
    return spark.createDataFrame(df).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


@pytest.mark.parametrize("size", [16, 100, 10_000])
def test_scans_equal_whole_windows(spark, size):
    df = series()
    got = scan.zscores(frame(spark, df).withColumn("z", F.col("x")), ["z"], ("universe", "asset"), "t", size)
    got = scan.mean_before(got, "x", ("universe", "asset"), "t", "before", size)
    got = scan.running_sum(got, F.col("x"), ("universe", "asset"), "t", "total", size)
    got = scan.numbered(got, ("universe", "asset"), "t", "place", size, "rows").toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    want = df.sort_values(["asset", "t"]).reset_index(drop=True)
    by = want.groupby("asset")["x"]
    mean, sd = (by.transform(lambda s, f=f: getattr(s.expanding(), f)()) for f in ("mean", "std"))
    z = ((want["x"] - mean) / sd).where((sd > 1e-12) & (want["asset"] != "flat"))
    np.testing.assert_allclose(got["z"].astype(float), z, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got["before"].astype(float), by.transform(lambda s: s.expanding().mean().shift()), rtol=1e-12)
    np.testing.assert_allclose(got["total"].astype(float), by.transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0)), rtol=1e-12)
    assert (got["place"] == got["t"]).all() and (got["rows"] == want.groupby("asset")["x"].transform("size")).all()
    assert list(got.columns) == ["universe", "asset", "x", "t", "z", "before", "total", "place", "rows"]


def test_scans_of_nothing_and_of_null_keys(spark):
    empty = spark.createDataFrame([], "universe string, asset string, t int, x double")
    assert scan.zscores(empty, ["x"], ("universe", "asset"), "t").count() == scan.numbered(empty, ("asset",), "t", "i").count() == 0
    rows = spark.createDataFrame([(None, i, float(i)) for i in range(10)], "asset string, t int, x double")
    assert [r["s"] for r in scan.running_sum(rows, F.col("x"), ("asset",), "t", "s", 3).orderBy("t").collect()] == np.cumsum(range(10)).tolist()


@pytest.mark.parametrize("run", [lambda d: X.expanding_zscore(d, ["x"]), lambda d: B.expanding_benchmark(d, "x"), lambda d: D.cumulative_log(d, "x", "t", ("universe", "asset"))])
def test_a_hot_asset_is_many_tasks(spark, run):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the rows of a test would be sent around
    try:
        long = spark.range(0, 40_000).select(F.lit("u").alias("universe"), F.lit("hot").alias("asset"), F.col("id").cast("int").alias("t"), (F.col("id") % 7 / 10).alias("x"), F.make_date((F.col("id") / 12 + 1).cast("int"), (F.col("id") % 12 + 1).cast("int"), F.lit(1)).alias("month"))
        out = run(long)
        tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash(*out.columns))).collect()
        assert len(tasks) >= 8 and sum(r["n"] for r in tasks) == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def groups(seed=1):
    rng = np.random.default_rng(seed)
    parts = [("a", rng.standard_cauchy(3_000)), ("b", rng.integers(0, 5, 2_000).astype(float)), ("c", np.r_[np.full(900, 7.0), rng.standard_normal(300)]), ("d", [1.5]), ("e", [2.0, -2.0])]
    return pd.concat([pd.DataFrame({"g": g, "x": np.asarray(x, float)}) for g, x in parts], ignore_index=True)


@pytest.mark.parametrize("dealt", [False, True])
def test_quantiles_and_ranks_are_exact(spark, monkeypatch, dealt):
    monkeypatch.setattr(order, "WHOLE", 0 if dealt else order.WHOLE)
    if dealt:
        monkeypatch.setattr(order, "ACCURACY", 20)  # bad splits make no difference
    df = groups()
    rows = spark.createDataFrame(df).unionByName(spark.createDataFrame([("a", None), ("z", None)], "g string, x double"))
    levels = {"lo": 0.0, "q1": 0.137, "mid": 0.5, "q9": 0.975, "hi": 1.0}
    got = order.quantiles(rows, "x", ("g",), levels).toPandas().set_index("g").sort_index()
    assert got.index.tolist() == list("abcde")
    for n, p in levels.items():
        np.testing.assert_allclose(got[n], df.groupby("g")["x"].quantile(p).sort_index(), rtol=1e-12)
    ranks = order.ranked(rows, "x", ("g",)).toPandas()
    assert len(ranks) == len(df) + 2 and ranks.loc[ranks["x"].isna(), "rank"].isna().all()
    ranks = ranks.dropna()
    np.testing.assert_array_equal(ranks["rank"], ranks.groupby("g")["x"].rank())
    assert (ranks["_all"] == ranks.groupby("g")["x"].transform("size")).all()


def test_no_task_sorts_a_dealt_group(spark, monkeypatch):
    monkeypatch.setattr(order, "WHOLE", 0)
    draws = spark.range(0, 20_000).select(F.lit("f").alias("field"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("chain"), F.col("id").alias("draw"), F.randn(1).alias("value"))
    values, buckets = order._counted(draws, "value", M.P)
    assert buckets.count() > 100 and buckets.agg(F.max("_size")).first()[0] < 1_000
    assert M.rank_normalised(draws).select("rank").distinct().count() == 20_000


def halves_by_definition(df, reps, k):
    """Rank correlations and overlaps of half_split_stability by whole sorts."""
    a1, a2, a3, a4 = M.SHUFFLE
    df = df[df["draw"] <= df["j"].map(df.groupby(["j", "chain"])["draw"].max().groupby("j").min())]
    out = []
    for rep in range(reps):
        pool = df[["chain", "draw"]].drop_duplicates()
        pool["mixed"] = ((pool["chain"] + 1) * a1 + (pool["draw"] + 1) * a2 + (rep + 1) * a3) % M.MODULUS * a4 % M.MODULUS
        pool = pool.sort_values(["mixed", "chain", "draw"])
        pool["first"] = np.arange(len(pool)) < len(pool) // 2
        size = df.merge(pool, on=["chain", "draw"]).groupby(["first", "j"])["value"].mean().abs().unstack()
        a, b = (size.loc[side].sort_index().rank(method="first") for side in (True, False))
        out.append((np.corrcoef(a, b)[0, 1], len(set(a.index[a > len(a) - k]) & set(b.index[b > len(b) - k])) / k))
    return out


@pytest.mark.parametrize("bits", [3, 19, 40])
def test_half_splits_of_long_chains(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "RANGE_BITS", bits, raising=False)
    n = 30_200  # 30,000 x 104,729 is beyond 32 bits
    j, chain, draw = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(2), np.arange(30_000, n), indexing="ij"))
    df = pd.DataFrame({"j": j, "chain": chain, "draw": draw, "value": np.random.default_rng(5).standard_normal(len(j))})
    df = df[(df["chain"] == 0) | (df["draw"] < n - 7 * (df["j"] + 1))]  # parameters' chains differ in length
    rows = spark.createDataFrame(df).select("j", F.col("chain").cast("int"), F.col("draw").cast("int"), "value")
    rho, overlap = np.array(halves_by_definition(df, 5, 2)).T
    got = M.half_split_stability(rows, 5, 2).first()
    np.testing.assert_allclose([*got], [np.median(rho), np.quantile(rho, 0.1), np.median(overlap), np.quantile(overlap, 0.1)], rtol=1e-9)


def rhat_by_steps(draws, by=("field",)):
    """rank_rhat with the ranks of every draw, value by value."""
    chain = ("chain", "half")
    middle = order.quantiles(draws, "value", by, {"m": 0.5})
    folded = draws.join(middle, list(by)).withColumn("folded", F.abs(F.col("value") - F.col("m"))).drop("m")
    bulk, tail = (M.classic_rhat(M.split(M.rank_normalised(d, by, c), by), "z", by, chain) for d, c in ((draws, "value"), (folded, "folded")))
    return bulk.withColumnRenamed("rhat", "bulk").join(tail.withColumnRenamed("rhat", "tail"), list(by))


def odd_chains():
    rng = np.random.default_rng(11)
    return {
        "long": [rng.standard_normal(301), rng.standard_normal(250) + 0.3, rng.standard_normal(277)],
        "tied": [rng.integers(0, 4, 90).astype(float), rng.integers(0, 5, 91).astype(float)],
        "stuck": [np.full(40, 1.5), np.full(40, 1.5 + 1e-9)],
        "flat": [np.full(9, 0.1), np.full(9, 0.1)],
        "gaps": [np.where(rng.random(60) < 0.2, np.nan, rng.standard_normal(60)), rng.standard_normal(61)],
        "none": [np.full(8, np.nan)],
        "single": [np.array([2.0])],
        "short": [np.array([1.0, 2.0, 4.0]), np.array([1.0, 5.0, 2.0])],
    }


@pytest.mark.parametrize("whole", [0, 1 << 18])
def test_rhat_of_counted_draws(spark, monkeypatch, whole):
    rows = [(f, c or None, d, None if v != v else float(v)) for f, cs in odd_chains().items() for c, x in enumerate(cs) for d, v in enumerate(x)]  # one chain's number is null
    df = spark.createDataFrame(rows, "field string, chain int, draw int, value double").repartition(5).cache()
    monkeypatch.setattr(order, "WHOLE", whole)
    monkeypatch.setattr(order, "STEP", 3)
    want = {r["field"]: (r["bulk"], r["tail"]) for r in rhat_by_steps(df).collect()}
    got = {r["field"]: (r["bulk"], r["tail"]) for r in M.rank_rhat(df, ("field",)).collect()}
    assert got.keys() == want.keys() and got["flat"] == got["stuck"] == (None, None)
    for f, w in want.items():
        np.testing.assert_allclose(np.array(got[f], float), np.array(w, float), rtol=1e-9, err_msg=f)


def test_diagnosis_reads_draws_once(spark):
    read = spark.sparkContext.accumulator(0)
    values = np.random.default_rng(12).standard_normal(2_000).tolist()

    def rows(part):
        for i in part:
            read.add(1)
            yield "f", i % 2, i // 2, values[i]

    draws = spark.createDataFrame(spark.sparkContext.parallelize(range(2_000), 4).mapPartitions(rows), "field string, chain int, draw int, value double")
    found = M.diagnosed(draws, ("field",)).first()
    assert read.value <= 2 * 2_000  # once for the numbers of chunks, once for the draws
    sizes_ = sizes.effective_sizes(draws, ("field",)).first()
    np.testing.assert_allclose([found["ess_bulk"], found["ess_tail"]], [sizes_["ess_bulk"], sizes_["ess_tail"]], rtol=1e-9)
    np.testing.assert_allclose(found["rhat"], max(rhat_by_steps(draws).first()[1:]), rtol=1e-9)


def panel(spark, n, months, k, seed=3):
    rng = np.random.default_rng(seed)
    f = np.concatenate([np.ones((n, months, 1)), rng.standard_normal((n, months, k - 1))], axis=2)
    r = rng.standard_normal((n, months)) + f.sum(axis=2) * 0.1
    rows = [("u", f"a{i}", t, f[i, t].tolist(), float(r[i, t])) for i in range(n) for t in range(months)]
    return f, r, spark.createDataFrame(rows, "universe string, asset string, t int, f array<double>, r_next double")


@pytest.mark.parametrize(("k", "penalty"), [(1, 0.0), (3, 0.0), (24, 0.0), (24, 2.5)])
def test_refits_equal_numpy(spark, k, penalty):
    f, r, p = panel(spark, 3, 90, k)
    got = R.backtests(p, [(40, 12), (60, 7)], penalty).toPandas()
    assert len(got) == 3 * (50 + 30)
    d = penalty * np.eye(k)
    d[0, 0] = 0
    for row in got.itertuples():
        i, t0 = int(row.asset[1:]), row.start + (row.t - row.start) // row.refit_every * row.refit_every
        x, y = f[i, :t0], r[i, :t0]
        assert row.t_refit == t0
        np.testing.assert_allclose(row.predicted, f[i, row.t] @ np.linalg.solve(x.T @ x + d, x.T @ y), rtol=1e-8)
        np.testing.assert_allclose([row.realised, row.benchmark], [r[i, row.t], r[i, : row.t].mean()], rtol=1e-10)


def test_pooled_scale_equals_numpy(spark):
    f, r, p = panel(spark, 4, 60, 5)
    sse = sum(np.linalg.lstsq(x, y, rcond=None)[1][0] for x, y in zip(f, r))
    assert R.pooled_scale(p).first()["sd"] == pytest.approx(np.sqrt(sse / (4 * 55)))
    assert R.pooled_scale(p.filter("t < 5")).first()["sd"] is None


def test_refits_without_full_rank_or_rows(spark):
    _, _, p = panel(spark, 2, 30, 3)
    twice = p.withColumn("f", F.concat("f", F.array(F.get("f", F.lit(1)))))  # its last column repeats another
    assert R.expanding_window(twice, 10, 5).agg(F.count("predicted")).first()[0] == 0
    assert R.expanding_window(twice, 10, 5, 1.0).agg(F.count("predicted")).first()[0] == 40  # a penalty settles it
    assert R.expanding_window(p, 2, 5).filter("t_refit = 2 AND predicted IS NOT NULL").count() == 0  # two rows, three unknowns
    assert R.expanding_window(p, 30, 5).count() == R.expanding_window(p.limit(0), 3, 5, k=3).count() == 0
    gap = p.filter("t < 10 OR t >= 20")  # a refit without rows of its own step still has the earlier ones
    assert R.expanding_window(gap, 10, 5).filter("predicted IS NOT NULL").count() == 20
    with pytest.raises(ValueError):
        R.backtests(p.unionByName(p.withColumn("f", F.array(F.lit(1.0)))), [(10, 5)])


def test_refits_see_nothing_ahead(spark):
    _, _, p = panel(spark, 2, 60, 3)
    found = B.lookahead(lambda q: R.expanding_window(q, 20, 10), p, 40, 10).first()
    assert found["before"] == 0 and found["after"] > 0


def test_refits_gather_nothing(spark, monkeypatch):
    _, _, p = panel(spark, 2, 40, 3)
    monkeypatch.setattr(B, "dense", None)
    monkeypatch.setattr(type(p), "toPandas", None)
    plan = R.expanding_window(p, 20, 10, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan


def sizes_by_definition(chains):
    n = min(map(len, chains))
    x = np.stack([np.asarray(c[:n], float) for c in chains])
    lo, hi = np.quantile(x, [0.05, 0.95])
    low, high = (M.effective_size(t.astype(float)) for t in (x < lo, x > hi))
    return M.effective_size(x), min(low, high) if low == low and high == high else np.nan


@pytest.mark.parametrize("block", [32, 512])
def test_effective_sizes_by_blocks(spark, block):
    rng = np.random.default_rng(21)

    def ar(rho, n):
        x = [0.0]
        for e in rng.standard_normal(n - 1):
            x.append(rho * x[-1] + e)
        return np.array(x)

    chains = {
        "quick": [ar(0.1, 300), ar(0.1, 301)],
        "slow": [ar(0.98, 251) + 3, ar(0.98, 250), ar(0.98, 260)],  # cut to the shortest
        "stuck": [np.arange(200.0), np.arange(200.0) + 1],
        "one": [ar(0.5, 157)],
        "flat": [np.ones(60), np.ones(60)],
        "short": [ar(0.5, 7), ar(0.5, 9)],
        "single": [np.array([1.0])],
        "broken": [np.array([*ar(0.1, 40), np.inf]), ar(0.1, 41)],
        "offset": [ar(0.3, 90) + 1e6, ar(0.3, 90) + 1e6],
    }
    rows = [(f, c, d, float(v)) for f, cs in chains.items() for c, x in enumerate(cs) for d, v in enumerate(x)]
    df = spark.createDataFrame(rows, "field string, chain int, draw int, value double").repartition(7)
    found = sizes.effective_sizes(df, ("field",), block)
    got = {r["field"]: (r["ess_bulk"], r["ess_tail"]) for r in found.collect()}
    assert got.keys() == chains.keys()
    for f, cs in chains.items():
        if f == "broken":
            assert got[f] == (None, None)
        else:
            np.testing.assert_allclose(np.array(got[f], float), sizes_by_definition(cs), rtol=1e-6, err_msg=f)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sizes.effective_sizes(df.limit(0), ("field",), block).count() == 0
