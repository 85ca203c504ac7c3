"""Queries of the library by name, each with its SQL where SQL can express it.

A query's columns are given once, as `name[:kind]`: i integers, f doubles rounded to DIGITS, d dates as text, b booleans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomgrid.functions import scalar as S
from fathomgrid.operators import backtest as B
from fathomgrid.operators import descriptive as D
from fathomgrid.operators import draws as M
from fathomgrid.operators import evaluation as E
from fathomgrid.operators import features as X
from fathomgrid.operators import least_squares as R
from fathomgrid.operators import panel as P
from fathomgrid.operators import sharpe_test as L
from fathomgrid.operators.order import settled

from . import testpanel as T
from .testpanel import EVERY, START, with_tables

DIGITS = 6
#: First refit of the fitters' backtests.
FIRST_REFIT = 24
#: Penalty of ridge_backtest.
PENALTY = 5.0
#: First refits and months between refits that refit_schedules compares.
SCHEDULES = [(START, EVERY), (START + EVERY, 5)]
Run = Callable[[SparkSession, str], DataFrame]
#: Normal CDF and quantile in SQL, with the constants of functions.scalar.
E0, E1, E2, E3, E4 = S.ERF


def cdf_sql(x: str) -> str:
    k = f"(1.0 / (1.0 + {S.ERF_P} * (abs({x}) / sqrt(2.0))))"
    erf = f"(1.0 - ((((({E4} * {k} + {E3}) * {k}) + {E2}) * {k} + {E1}) * {k} + {E0}) * {k} * exp(-({x}) * ({x}) / 2.0))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1.0 + {erf}) ELSE 0.5 * (1.0 - {erf}) END)"


def horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def quantile_sql(p: str) -> str:
    tail = lambda r: f"({horner_sql(S.QC, r)} / {horner_sql((*S.QD, 1.0), r)})"
    q = f"({p} - 0.5)"
    middle = f"({horner_sql(S.QA, f'({q} * {q})')} * {q} / {horner_sql((*S.QB, 1.0), f'({q} * {q})')})"
    return f"(CASE WHEN {p} < {S.TAIL} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - S.TAIL} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END)"


@dataclass(frozen=True)
class Query:
    columns: str
    run: Run
    sql: str | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        shape = {"i": lambda c: F.col(c).cast("long"), "f": lambda c: F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0), "d": lambda c: F.date_format(c, "yyyy-MM-dd"), "b": F.col, "s": lambda c: F.col(c).cast("string")}
        return df.select(*(shape[kind](name).alias(name) for name, kind in self.parts()))

    def oracle(self) -> str:
        shape = {"i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), %d) + 0.0" % DIGITS, "d": "strftime({0}, '%Y-%m-%d')", "b": "{0}", "s": "CAST({0} AS VARCHAR)"}
        with_part, _, body = self.sql.rpartition("\n--\n")
        return f"{with_part}\nSELECT " + ", ".join(f"{shape[kind].format(name)} AS {name}" for name, kind in self.parts()) + f" FROM ({body}) AS result"

    def parts(self) -> list[tuple[str, str]]:
        return [(n, k or "s") for n, _, k in (c.partition(":") for c in self.columns.split())]


def q(tables: str, body: str, more: str = "") -> str:
    head = with_tables(*tables.split()) if tables else ""
    if more:
        head = f"{head},\n{more}" if head else f"WITH {more}"
    return f"{head}\n--\n{body}"


def ar1(spark: SparkSession, d: str) -> DataFrame:
    return B.ar1_forecasts(T.responses(spark, d), START, EVERY)


def both_models(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of both models side by side: predicted (AR(1)) and prefix (mean)."""
    return B.ar1_fits(T.responses(spark, d), START, EVERY).withColumn("predicted", F.col("a") + F.col("b") * F.col("ret"))


def portfolio(spark: SparkSession, d: str) -> DataFrame:
    return E.portfolio(E.weights(ar1(spark, d)))


def model_returns(spark: SparkSession, d: str) -> DataFrame:
    """Portfolio returns (universe, model, t, q) of the AR(1) forecasts and of the benchmark's."""
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in (("ar1", "predicted"), ("mean", "benchmark"))))
    f = ar1(spark, d).select("universe", "asset", "t", "realised", F.explode(models).alias("m")).select("universe", "asset", "t", "realised", "m.*")
    by = ("universe", "model", "t")
    return E.portfolio(E.weights(f, by), by)


def excess(spark: SparkSession, d: str) -> DataFrame:
    return P.excess_returns(T.returns(spark, d), T.rates(spark, d))


def interval_rows(spark: SparkSession, d: str) -> DataFrame:
    """AR(1) forecasts with intervals of one and two expanding residual deviations."""
    sd = F.stddev_samp(F.col("realised") - F.col("benchmark")).over(W.partitionBy("universe", "asset").orderBy("t").rowsBetween(W.unboundedPreceding, -1))
    f = ar1(spark, d).withColumn("_s", sd).filter("_s is not null")
    return f.select("universe", "asset", "t", "realised", *((F.col("predicted") + k * F.col("_s")).alias(n) for n, k in (("lo_coef", -1.0), ("hi_coef", 1.0), ("lo_full", -2.0), ("hi_full", 2.0))))


def lookahead_check(spark: SparkSession, d: str) -> DataFrame:
    """Over all universes: the largest change before the corruption, the least of their changes after it."""
    found = B.lookahead(lambda p: B.ar1_forecasts(p, START, EVERY), T.responses(spark, d), START + EVERY, EVERY, by=("universe",))
    return found.agg(F.max("before").alias("before"), F.min("after").alias("after"))


def metrics_by_model(spark: SparkSession, d: str) -> DataFrame:
    return E.scores(model_returns(spark, d), ("universe", "model"))


LRV = """s AS (SELECT universe, t, {d} AS d FROM {src} GROUP BY universe, t),
  c AS (SELECT universe, row_number() OVER (PARTITION BY universe ORDER BY t) AS i, d - avg(d) OVER (PARTITION BY universe) AS c, count(*) OVER (PARTITION BY universe) AS n FROM s),
  a AS (SELECT x.universe, y.i - x.i AS k, sum(x.c * y.c) / any_value(x.n) AS g, any_value(x.n) AS n, any_value(floor(4 * pow(x.n / 100.0, 2.0 / 9))) AS l FROM c x JOIN c y ON x.universe = y.universe AND y.i >= x.i AND y.i - x.i <= floor(4 * pow(x.n / 100.0, 2.0 / 9)) GROUP BY 1, 2),
  lrv AS (SELECT universe, max(n) AS n, max(l) AS lags, greatest(0, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (l + 1)) * g END)) AS lrv FROM a GROUP BY 1),
  tested AS (SELECT universe, n, lags, lrv, mean, mean / sqrt(lrv / n) AS stat FROM lrv JOIN (SELECT universe, avg(d) AS mean FROM s GROUP BY 1) USING (universe))"""
SHARPE = "CASE WHEN stddev_samp(q) > 1e-12 * max(abs(q)) THEN avg(q) / stddev_samp(q) * sqrt(12) END"
CE = "12 * (avg(q) - 1.5 * var_samp(q))"
DM_D = "avg(pow(realised - predicted, 2)) - avg(pow(realised - prefix, 2))"
CW_D = "avg(pow(realised - benchmark, 2) - pow(realised - predicted, 2) + pow(benchmark - predicted, 2))"
MODELS = """m2 AS (SELECT universe, asset, t, benchmark - avg(benchmark) OVER (PARTITION BY universe, t) AS d, benchmark, realised FROM forecasts),
  m3 AS (SELECT *, sum(abs(d)) OVER (PARTITION BY universe, t) AS g, sum(abs(benchmark)) OVER (PARTITION BY universe, t) AS p FROM m2),
  model_returns AS (SELECT universe, 'ar1' AS model, t, q FROM portfolio UNION ALL SELECT universe, 'mean', t, sum(CASE WHEN g > 1e-12 * greatest(p, 1e-300) THEN d / g ELSE 0 END * realised) FROM m3 GROUP BY universe, t)"""
INTERVALS = """iv AS (SELECT *, stddev_samp(realised - benchmark) OVER (PARTITION BY universe, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM forecasts)"""
RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY field ORDER BY value) + (count(*) OVER (PARTITION BY field, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY field) AS s FROM {0}), z AS (SELECT *, {1} AS z FROM rk)"
Z = RANKED.format("draws", quantile_sql("((rank - 0.375) / (s + 0.25))"))
FOLDED = "fd AS (SELECT field, chain, draw, abs(value - median(value) OVER (PARTITION BY field)) AS value FROM draws), fr AS (SELECT *, rank() OVER (PARTITION BY field ORDER BY value) + (count(*) OVER (PARTITION BY field, value) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY field) AS s FROM fd), fz AS (SELECT *, " + quantile_sql("((rank - 0.375) / (s + 0.25))") + " AS z FROM fr)"


def rhat_sql(src: str, value: str, name: str, halves: bool = True) -> str:
    if halves:
        half = f"""{name}_p AS (SELECT field, chain, {value} AS x, row_number() OVER (PARTITION BY field, chain ORDER BY draw) - 1 AS pos, count(*) OVER (PARTITION BY field, chain) AS n FROM {src}),
  {name}_h AS (SELECT field, chain, CASE WHEN pos < n // 2 THEN 0 WHEN pos >= n - n // 2 THEN 1 END AS half, x FROM {name}_p)"""
    else:
        half = f"{name}_h AS (SELECT field, chain, 0 AS half, {value} AS x FROM {src})"
    return f"""{half},
  {name}_c AS (SELECT field, chain, half, var_samp(x) AS v, avg(x) AS m, count(*) AS n FROM {name}_h WHERE half IS NOT NULL GROUP BY 1, 2, 3),
  {name} AS (SELECT field, CASE WHEN avg(v) > 0 THEN sqrt(((min(n) - 1) / min(n)::DOUBLE * avg(v) + var_samp(m)) / avg(v)) END AS rhat FROM {name}_c GROUP BY 1)"""


def ess_sql(src: str, value: str, name: str, by: str = "field") -> str:
    """Effective sizes of a table (by, chain, draw, ...) as name (by, ess): halves of the chains, sums of products at all
    lags, pairs of autocorrelations up to the first that isn't positive."""
    return f"""{name}_p AS (SELECT {by}, chain, {value} AS x, row_number() OVER (PARTITION BY {by}, chain ORDER BY draw) - 1 AS pos FROM {src}),
  {name}_l AS (SELECT {by}, min(k) AS n FROM (SELECT {by}, chain, count(*) AS k FROM {name}_p GROUP BY ALL) GROUP BY ALL),
  {name}_h AS (SELECT {by}, chain, pos >= n // 2 AS half, pos - CASE WHEN pos < n // 2 THEN 0 ELSE n - n // 2 END AS i, x::DOUBLE AS x, n // 2 AS n FROM {name}_p JOIN {name}_l USING ({by}) WHERE pos < n // 2 OR pos >= n - n // 2 AND pos < n),
  {name}_c AS (SELECT *, x - avg(x) OVER (PARTITION BY {by}, chain, half) AS c FROM {name}_h),
  {name}_a AS (SELECT {', '.join(f'a.{b} AS {b}' for b in by.split(', '))}, a.chain, a.half, b.i - a.i AS lag, sum(a.c * b.c) / any_value(a.n) AS g, any_value(a.n) AS n FROM {name}_c a JOIN {name}_c b ON {' AND '.join(f'a.{b} = b.{b}' for b in by.split(', '))} AND a.chain = b.chain AND a.half = b.half AND b.i >= a.i GROUP BY ALL),
  {name}_m AS (SELECT {by}, chain, half, avg(x) AS m FROM {name}_h GROUP BY ALL),
  {name}_w AS (SELECT {by}, max(n) AS n, count(*) AS k, avg(g * n / (n - 1)) AS w FROM {name}_a WHERE lag = 0 GROUP BY ALL),
  {name}_v AS (SELECT {by}, var_samp(m) AS b FROM {name}_m GROUP BY ALL),
  {name}_t AS (SELECT {by}, n, k, w, (n - 1) / n::DOUBLE * w + b AS total FROM {name}_w JOIN {name}_v USING ({by})),
  {name}_g AS (SELECT {by}, lag, avg(g) AS g FROM {name}_a GROUP BY ALL),
  {name}_r AS (SELECT {by}, lag, CASE WHEN lag = 0 THEN 1 ELSE 1 - (w - g) / total END AS rho FROM {name}_g JOIN {name}_t USING ({by}) WHERE lag < n // 2 * 2),
  {name}_q AS (SELECT {by}, lag // 2 AS pair, sum(rho) AS p FROM {name}_r GROUP BY ALL),
  {name}_s AS (SELECT {by}, sum(p) AS s FROM (SELECT *, min(CASE WHEN p <= 0 THEN pair END) OVER (PARTITION BY {by}) AS stop FROM {name}_q) WHERE stop IS NULL OR pair < stop GROUP BY ALL),
  {name} AS (SELECT {by}, CASE WHEN n >= 4 AND w > 0 THEN k * n / greatest(-1 + 2 * s, 1 / log10(greatest(k * n, 11))) END AS ess FROM {name}_t JOIN {name}_s USING ({by}))"""


def sizes_sql(src: str, name: str, by: str = "field") -> str:
    """Bulk and tail sizes of a table (by, chain, draw, value) as name (by, ess_bulk, ess_tail)."""
    tails = f"""{name}_x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}, chain ORDER BY draw) AS pos FROM {src}) JOIN (SELECT {by}, min(k) AS k FROM (SELECT {by}, chain, count(*) AS k FROM {src} GROUP BY ALL) GROUP BY ALL) USING ({by}) WHERE pos <= k),
  {name}_e AS (SELECT {by}, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM {name}_x GROUP BY ALL),
  {name}_i AS (SELECT {by}, chain, draw, (value < lo)::INT AS low, (value > hi)::INT AS high FROM {name}_x JOIN {name}_e USING ({by}))"""
    parts = [ess_sql(src, "value", f"{name}_bulk", by), tails, ess_sql(f"{name}_i", "low", f"{name}_low", by), ess_sql(f"{name}_i", "high", f"{name}_high", by)]
    return ",\n  ".join(parts) + f""",
  {name} AS (SELECT {by}, b.ess AS ess_bulk, CASE WHEN l.ess IS NOT NULL AND h.ess IS NOT NULL THEN least(l.ess, h.ess) END AS ess_tail FROM {name}_bulk b JOIN {name}_low l USING ({by}) JOIN {name}_high h USING ({by}))"""


def budget_sql(n: int) -> str:
    """Diagnosis of the first n draws as d{n}."""
    src = f"draws{n}"
    z = RANKED.format(src, quantile_sql("((rank - 0.375) / (s + 0.25))")).replace("rk ", f"rk{n} ").replace("FROM rk", f"FROM rk{n}").replace(" z AS (", f" z{n} AS (")
    folded = FOLDED.replace("fd ", f"fd{n} ").replace("FROM fd", f"FROM fd{n}").replace("fr ", f"fr{n} ").replace("FROM fr", f"FROM fr{n}").replace("fz ", f"fz{n} ").replace("FROM draws", f"FROM {src}")
    return f"""{src} AS (SELECT * FROM draws WHERE draw < {n}), {z}, {folded}, {rhat_sql(f'z{n}', 'z', f'rb{n}')}, {rhat_sql(f'fz{n}', 'z', f'rt{n}')}, {sizes_sql(src, f'es{n}')},
  d{n} AS (SELECT {n} AS n, field, greatest(b.rhat, t.rhat) AS rhat, ess_bulk FROM rb{n} b JOIN rt{n} t USING (field) JOIN es{n} USING (field))"""


OWN = X.OWN
OWN_F = " ".join(f"{c}:f" for c in OWN)


def zscore_sql(c: str, over: str = "w") -> str:
    return f"CASE WHEN stddev_samp({c}) OVER {over} <> 0 THEN ({c} - avg({c}) OVER {over}) / stddev_samp({c}) OVER {over} END AS {c}"


SCORED = f"""scored AS (SELECT universe, asset, month, {', '.join(zscore_sql(c) for c in OWN)}, lead(ret) OVER (PARTITION BY universe, asset ORDER BY month) AS r_next, row_number() OVER (PARTITION BY universe, asset ORDER BY month) AS rn
    FROM history WINDOW w AS (PARTITION BY universe, asset ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  shared AS (SELECT month, {', '.join(zscore_sql(c) for c in T.COMMON)} FROM common WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  kept AS (SELECT * FROM scored JOIN shared USING (month) WHERE rn > 30 AND ret_lag1 IS NOT NULL AND vol12 IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL AND r_next IS NOT NULL)"""
#: The model panel without stabilisation, and the normal equations of each refit.
COLUMNS = ["1.0", *T.COMMON, "ret_lag1", "vol12", *(f"{c} * {o}" for c in T.COMMON for o in ("ret_lag1", "vol12"))]
NAMES = P.predictor_names(T.COMMON, ["ret_lag1", "vol12"])
INTER = [f"{c}_x_{o}" for c in T.COMMON for o in ("ret_lag1", "vol12")]


def solve_sql(source: str, k: int, penalty: float) -> str:
    """Gauss-Jordan elimination of normal equations as CTEs: from source (key, i, j, v; j = k is the right side) to solved (key, i, b)."""
    steps = [f"m0 AS MATERIALIZED (SELECT key, i, j, v + CASE WHEN i = j AND i > 0 THEN {penalty} ELSE 0 END AS v FROM {source})"]
    for p in range(k):
        steps.append(
            f"m{p + 1} AS MATERIALIZED (SELECT m.key, m.i, m.j, CASE WHEN m.i = {p} THEN r.v / d.v ELSE m.v - c.v * r.v / d.v END AS v "
            f"FROM m{p} m JOIN m{p} r ON r.key = m.key AND r.i = {p} AND r.j = m.j JOIN m{p} c ON c.key = m.key AND c.i = m.i AND c.j = {p} JOIN m{p} d ON d.key = m.key AND d.i = {p} AND d.j = {p})"
        )
    return ",\n  ".join([*steps, f"solved AS (SELECT key, i, v AS b FROM m{k} WHERE j = {k})"])


RIDGE = q(
    "history common",
    """SELECT x.universe, x.asset, x.t, x.t_refit, sum(x.v * s.b) AS predicted, any_value(x.r_next) AS realised, any_value(x.benchmark) AS benchmark
  FROM asked x JOIN solved s ON s.key = x.key AND s.i = x.i GROUP BY ALL""",
    f"""{SCORED.replace("rn > 30 AND", "")},
  panel AS (SELECT universe, asset, r_next, [{', '.join(COLUMNS)}]::DOUBLE[] AS f, row_number() OVER (PARTITION BY universe, asset ORDER BY month) - 1 AS t FROM kept),
  rows_ AS (SELECT *, avg(r_next) OVER (PARTITION BY universe, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS benchmark FROM panel),
  refits AS (SELECT DISTINCT universe, asset, {FIRST_REFIT} + (t - {FIRST_REFIT}) // {EVERY} * {EVERY} AS t_refit FROM panel WHERE t >= {FIRST_REFIT}),
  asked AS (SELECT universe, asset, t, {FIRST_REFIT} + (t - {FIRST_REFIT}) // {EVERY} * {EVERY} AS t_refit, (universe, asset, {FIRST_REFIT} + (t - {FIRST_REFIT}) // {EVERY} * {EVERY}) AS key, r_next, benchmark, unnest(range({len(COLUMNS)})) AS i, unnest(f) AS v FROM rows_ WHERE t >= {FIRST_REFIT}),
  trained AS (SELECT (r.universe, r.asset, r.t_refit) AS key, list_append(p.f, p.r_next) AS z FROM refits r JOIN panel p ON p.universe = r.universe AND p.asset = r.asset AND p.t < r.t_refit),
  equations AS (SELECT key, i, j, sum(z[i + 1] * z[j + 1]) AS v FROM trained, range({len(COLUMNS)}) a(i), range({len(COLUMNS) + 1}) b(j) GROUP BY key, i, j),
  {solve_sql("equations", len(COLUMNS), PENALTY)}""",
)


def interactions_query(spark: SparkSession, d: str) -> DataFrame:
    s = P.complete(P.stabilised(T.scored(spark, d, ["ret_lag1", "vol12"])), ["ret_lag1", "vol12", *T.COMMON, "r_next"])
    return s.select("universe", "asset", "month", *P.interactions(T.COMMON, ["ret_lag1", "vol12"]))


def panel_features(spark: SparkSession, d: str) -> DataFrame:
    p = T.model_panel(spark, d)
    return p.select("universe", "asset", "month", "t", "r_next", F.size("f").alias("k"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("f_sum"), S.dot(F.col("f"), F.col("f")).alias("f_norm2"))


def fitted(spark: SparkSession, d: str, fit, covariance: bool = False) -> DataFrame:
    """Forecasts of a fitter for the model panel of every universe, each fitted by itself.

    Refits are at FIRST_REFIT, FIRST_REFIT + EVERY and so on. A fitter that needs the covariance of the assets' returns
    begins at the first of them with more months than assets, as it has no estimate before. A universe whose months do
    not reach its first refit has nothing to forecast and is left out.
    """
    p = settled(T.model_panel(spark, d, 0))  # read for each universe and for the forecasts
    sizes = p.groupBy("universe").agg((F.max("t") + 1).alias("months"), F.countDistinct("asset").alias("assets")).orderBy("universe").collect()
    fits = None
    for universe, months, assets in sizes:
        start = FIRST_REFIT
        while covariance and start <= assets:
            start += EVERY
        if months > start:
            one = B.coefficients(p.filter(F.col("universe") == universe), fit, start, EVERY).withColumn("universe", F.lit(universe))
            fits = one if fits is None else fits.unionByName(one)
    if fits is None:
        raise ValueError(f"no universe's months reach its first refit: {sizes}")
    return B.forecasts(p, fits, FIRST_REFIT, EVERY)  # starts are whole steps apart, so the refits' keys are the same


def predictor_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each predictor's group and root mean square over a universe's panel."""
    each = T.model_panel(spark, d).select("universe", F.posexplode("f").alias("at", "x")).groupBy("universe", "at").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    named = each.withColumn("name", F.element_at(F.lit(NAMES), F.col("at") + 1))
    return named.select("universe", "name", P.predictor_group(F.col("name"), T.COMMON).alias("grp"), "rms")


def ridge_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Ridge forecasts of every universe; one whose months don't reach FIRST_REFIT has none."""
    return R.expanding_window(T.model_panel(spark, d, 0), FIRST_REFIT, EVERY, PENALTY, k=len(COLUMNS))


def by_universe(panel: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run on each universe's rows by itself, told apart by that column."""
    out = None
    for r in panel.select("universe").distinct().orderBy("universe").collect():
        one = run(panel.filter(F.col("universe") == r[0]).drop("universe")).withColumn("universe", F.lit(r[0]))
        out = one if out is None else out.unionByName(one)
    return out


def simple_panel(spark: SparkSession, d: str) -> DataFrame:
    """The responses with an intercept and the last return as predictors."""
    return T.responses(spark, d).withColumn("f", F.array(F.lit(1.0), "ret"))


def refit_schedules(spark: SparkSession, d: str) -> DataFrame:
    return R.backtests(simple_panel(spark, d), SCHEDULES, k=2)


def pooled_scale(spark: SparkSession, d: str) -> DataFrame:
    return R.pooled_scale(simple_panel(spark, d), k=2)


def predictive_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the Gaussian model's intervals by universe, with its whole budget; refits every two years."""
    from fathomgrid.models.fitters import interval_fitter

    rows = by_universe(simple_panel(spark, d), lambda p: B.intervals(p, interval_fitter("gaussian"), START, 2 * EVERY))
    return E.coverage(rows)


def gibbs_backtest(spark: SparkSession, d: str) -> DataFrame:
    from fathomgrid.models.fitters import fitter

    return fitted(spark, d, fitter("gaussian"), covariance=True)


def budget_validation(draws: DataFrame) -> DataFrame:
    """The first 50 draws of each chain as the short run; events' types are the parameters of one field."""
    named = draws.select(F.lit("b").alias("field"), F.lit(0).alias("i"), F.col("field").alias("j"), "chain", "draw", "value")
    return M.budget_validation(named.filter("draw < 50"), named.groupBy(*M.P).agg(F.avg("value").alias("mean")), 300.0)


def predictors_of(spark: SparkSession, d: str) -> DataFrame:
    return P.complete(P.stabilised(T.scored(spark, d, ["ret_lag1", "vol12"])), ["ret_lag1", "vol12", *T.COMMON, "r_next"])


PRED = ["ret_lag1", "vol12", "disc", "tax", "qty"]
CORR_SQL = "corr AS (" + " UNION ALL ".join(f"SELECT universe, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM kept GROUP BY universe" for i, a in enumerate(PRED) for b in PRED[i + 1 :]) + ")"


def sharpe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.compared(model_returns(spark, d), [("ar1", "mean")])


def bootstrap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """sharpe_pairs with the stacked portfolio as a fourth universe."""
    r = every = model_returns(spark, d)
    for m in ("ar1", "mean"):
        every = every.unionByName(E.stacked(r.filter(F.col("model") == m)).withColumns({"universe": F.lit("stacked"), "model": F.lit(m)}))
    return L.compared(every, [("ar1", "mean")])


def named_corr(spark: SparkSession, d: str) -> DataFrame:
    return D.correlations(predictors_of(spark, d), PRED)


HAC = f"""{MODELS},
  pr AS (SELECT a.universe, a.t, a.q AS r1, b.q AS r2 FROM model_returns a JOIN model_returns b USING (universe, t) WHERE a.model = 'ar1' AND b.model = 'mean'),
  mo AS (SELECT universe, count(*) AS n, avg(r1) AS m1, avg(r2) AS m2, avg(r1 * r1) AS g1, avg(r2 * r2) AS g2 FROM pr GROUP BY 1 HAVING avg(r1 * r1) - pow(avg(r1), 2) > 0 AND avg(r2 * r2) - pow(avg(r2), 2) > 0),
  md AS (SELECT *, pow(g1 - m1 * m1, 1.5) AS s1, pow(g2 - m2 * m2, 1.5) AS s2, m1 / sqrt(g1 - m1 * m1) - m2 / sqrt(g2 - m2 * m2) AS delta, floor(4 * pow(n / 100.0, 2.0 / 9)) AS lags FROM mo),
  zz AS (SELECT universe, row_number() OVER (PARTITION BY universe ORDER BY t) AS i, n, lags, delta, g1 / s1 * (r1 - m1) - g2 / s2 * (r2 - m2) - m1 / (2 * s1) * (r1 * r1 - g1) + m2 / (2 * s2) * (r2 * r2 - g2) AS z FROM pr JOIN md USING (universe)),
  ps AS (SELECT x.universe, any_value(x.n) AS n, any_value(x.lags) AS lags, any_value(x.delta) AS delta, sum(CASE WHEN y.i = x.i THEN 1.0 ELSE 2 * (1 - (y.i - x.i) / (x.lags + 1)) END * x.z * y.z / x.n) AS psi FROM zz x JOIN zz y ON x.universe = y.universe AND y.i >= x.i AND y.i - x.i <= x.lags GROUP BY 1)"""


def bootstrap_sql() -> str:
    """Every block sample spelt out, row by row."""
    a, b, c, d = L.COUNTER
    fifth = lambda x, y: f"{x} * {x} % {L.MODULUS} AS {x}2, {x}2 * {x}2 % {L.MODULUS} * {x} % {L.MODULUS} AS {y}"
    pairs = HAC.replace(",\n  pr AS", ",\n  every_q AS (SELECT * FROM model_returns UNION ALL SELECT 'stacked', model, t, avg(q) FROM model_returns GROUP BY model, t),\n  pr AS").replace("FROM model_returns a JOIN model_returns b", "FROM every_q a JOIN every_q b")
    return f"""{pairs},
  bx AS (SELECT universe, row_number() OVER (PARTITION BY universe ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY universe) AS n, r1, r2 FROM pr),
  bj AS (SELECT universe, n, block, rep, unnest(range((n + block - 1) // block)) AS j FROM (SELECT DISTINCT universe, n FROM bx), (SELECT unnest({list(L.BLOCKS)}) AS block), (SELECT unnest(range({L.REPLICATES})) AS rep) WHERE block <= n),
  bd AS (SELECT *, (rep * {a} + j * {b} + block * {c} + 1) % {L.MODULUS} AS x, {fifth("x", "f")}, (f + j * {a} + rep * {b} + 1) % {L.MODULUS} AS y, {fifth("y", "e")}, e % n AS start FROM bj),
  bo AS (SELECT universe, n, block, rep, j, (start + o) % n AS i FROM (SELECT universe, n, block, rep, j, start, unnest(range(block)) AS o FROM bd) WHERE j * block + o < n),
  bs AS (SELECT bo.*, r1, r2 FROM bo JOIN bx USING (universe, i)),
  bm AS (SELECT universe, block, rep, avg(r1) AS m1, avg(r2) AS m2, avg(r1 * r1) AS g1, avg(r2 * r2) AS g2 FROM bs GROUP BY 1, 2, 3),
  bg AS (SELECT *, pow(g1 - m1 * m1, 1.5) AS s1, pow(g2 - m2 * m2, 1.5) AS s2, m1 / sqrt(g1 - m1 * m1) - m2 / sqrt(g2 - m2 * m2) AS sample FROM bm WHERE g1 > m1 * m1 AND g2 > m2 * m2),
  bz AS (SELECT universe, block, rep, j, any_value(n) AS n, any_value(sample) AS sample, sum(g1 / s1 * (r1 - m1) - g2 / s2 * (r2 - m2) - m1 / (2 * s1) * (r1 * r1 - g1) + m2 / (2 * s2) * (r2 * r2 - g2)) AS s FROM bs JOIN bg USING (universe, block, rep) WHERE (j + 1) * block <= n GROUP BY 1, 2, 3, 4),
  bt AS (SELECT universe, block, rep, any_value(sample) AS sample, sqrt(sum(s * s) / any_value(block) / count(*) / any_value(n)) AS e FROM bz GROUP BY 1, 2, 3)"""


# Of these four the queries without _all keep to the part types, as their SQL does; these take every universe.
def gram_blocks_all(spark: SparkSession, d: str) -> DataFrame:
    p = predictors_of(spark, d)
    left = p.select("universe", "month", F.col("asset").alias("i"), F.col("vol12").alias("x"))
    right = p.select("universe", "month", F.col("asset").alias("j"), F.col("vol12").alias("y"))
    return left.join(right, ["universe", "month"]).groupBy("universe", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def training_rows_all(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of every refit from START to the last month of each universe."""
    p = T.responses(spark, d)
    last = p.groupBy("universe").agg(F.max("t").alias("last")).filter(F.col("last") >= START)
    refits = last.select("universe", F.explode(F.sequence(F.lit(START), F.col("last").cast("int"), F.lit(EVERY))).alias("t_refit"))
    return B.training_rows(p, refits).groupBy("universe", "t_refit").agg(F.count(F.lit(1)).alias("n"), F.sum("r_next").alias("s"))


def restricted_months_all(spark: SparkSession, d: str) -> DataFrame:
    """Common predictors in the months of each universe; fails when run if a month has none."""
    months = T.returns(spark, d).select("universe", "month").distinct()
    return P.restricted(T.common(spark, d), months).join(months, "month")


def all_queries() -> dict[str, Query]:
    out = {
        "monthly_revenue": Query("universe asset month:d rev:f", T.revenue, q("revenue", "SELECT * FROM revenue")),
        "listwise_panel": Query("universe asset month:d t:i ret:f", T.returns, q("returns", "SELECT * FROM returns")),
        "excess_returns": Query("universe asset month:d ret:f", excess, q("returns common", "SELECT universe, asset, r.month, ret - tax / 10 AS ret FROM returns r JOIN common c ON r.month = c.month")),
        "aligned_range": Query(
            "universe asset month:d ret:f",
            lambda s, d: P.common_range(T.raw_returns(s, d).filter("ret is not null and month >= '1996-01-01'"), T.common(s, d).filter("month < '2001-01-01'"))[0],
            q("raw common", "SELECT * FROM raw WHERE ret IS NOT NULL AND month >= DATE '1996-01-01' AND month >= (SELECT min(month) FROM common) AND month <= (SELECT max(month) FROM common WHERE month < DATE '2001-01-01') AND month <= (SELECT max(month) FROM raw)"),
        ),
        "restricted_months": Query("month:d disc:f", lambda s, d: P.restricted(T.common(s, d), T.returns(s, d).filter("universe = 'type'")), q("returns common", "SELECT month, disc FROM common SEMI JOIN (SELECT * FROM returns WHERE universe = 'type') r USING (month)")),
        "common_months": Query("month:d", lambda s, d: T.returns(s, d).filter("universe = 'brand'").select("month").intersect(T.returns(s, d).filter("universe = 'nation'").select("month")), q("returns", "SELECT month FROM returns WHERE universe = 'brand' INTERSECT SELECT month FROM returns WHERE universe = 'nation'")),
        "sentinel_recode": Query(
            "asset month:d ret:f",
            lambda s, d: P.recode_sentinels(T.returns(s, d).filter("universe = 'type'").select("asset", "month", F.when(F.pmod("t", F.lit(7)) == 0, -99.99).when(F.pmod("t", F.lit(11)) == 0, -999.0).otherwise(F.col("ret")).alias("ret")), ["ret"]),
            q("returns", "SELECT asset, month, CASE WHEN t % 7 = 0 OR t % 11 = 0 THEN NULL ELSE ret END AS ret FROM returns WHERE universe = 'type'"),
        ),
        "month_parse": Query("yyyymm:i month:d pct:f", lambda s, d: T.common(s, d).select((F.year("month") * 100 + F.month("month")).alias("yyyymm"), "disc").select("yyyymm", P.month_start(F.col("yyyymm")).alias("month"), "disc").transform(lambda x: P.percent_to_decimal(x, ["disc"])).withColumnRenamed("disc", "pct"), q("common", "SELECT year(month) * 100 + month(month) AS yyyymm, month, disc / 100 AS pct FROM common")),
        "macro_features": Query(
            "month:d BM:f NTIS:f SVAR:f TBL:f CPI:f DY:f EP:f DFY:f TMS:f",
            lambda s, d: P.macro_features(T.macro_raw(s, d)),
            q("macro", "SELECT month, bm AS BM, ntis AS NTIS, svar AS SVAR, tbl AS TBL, infl AS CPI, ln(d12) - ln(lag(idx) OVER (ORDER BY month)) AS DY, ln(e12) - ln(idx) AS EP, baa - aaa AS DFY, lty - tbl AS TMS FROM macro"),
        ),
        "own_history_features": Query(f"universe asset month:d {OWN_F}", T.history, q("history", "SELECT * FROM history")),
        "expanding_zscore": Query(
            f"universe asset month:d {OWN_F}",
            lambda s, d: X.expanding_zscore(T.history(s, d), OWN),
            q("history", f"SELECT universe, asset, month, {', '.join(zscore_sql(c) for c in OWN)} FROM history WINDOW w AS (PARTITION BY universe, asset ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        ),
        "lead_response": Query("universe asset t:i r_next:f", T.responses, q("responses", "SELECT * FROM responses")),
        "interactions": Query(f"universe asset month:d {' '.join(f'{c}:f' for c in INTER)}", interactions_query, q("history common", "SELECT universe, asset, month, " + ", ".join(f"{c} * {o} AS {c}_x_{o}" for c in T.COMMON for o in ("ret_lag1", "vol12")) + " FROM kept", SCORED)),
        "panel_features": Query(
            "universe asset month:d t:i r_next:f k:i f_sum:f f_norm2:f",
            panel_features,
            q(
                "history common",
                "SELECT universe, asset, month, row_number() OVER (PARTITION BY universe, asset ORDER BY month) - 1 AS t, r_next, len(f) AS k, list_sum(f) AS f_sum, list_sum(list_transform(f, lambda x: x * x)) AS f_norm2 FROM vec",
                SCORED + ", vec AS (SELECT *, [1.0::DOUBLE, disc, tax, qty, ret_lag1, vol12, " + ", ".join(f"{c} * {o}" for c in T.COMMON for o in ("ret_lag1", "vol12")) + "] AS f FROM kept)",
            ),
        ),
        "panel_metadata": Query(
            "universe n_assets:i K:i T:i first last",
            lambda s, d: __import__("fathomgrid.sources.stores", fromlist=["x"]).panel_metadata(T.returns(s, d), ["ret"]).select("universe", "n_assets", "K", "T", F.col("date_range")[0].alias("first"), F.col("date_range")[1].alias("last")),
            q("returns", "SELECT universe, count(DISTINCT asset) AS n_assets, 1 AS K, count(DISTINCT month) AS T, strftime(min(month), '%Y-%m-%d') AS first, strftime(max(month), '%Y-%m-%d') AS last FROM returns GROUP BY 1"),
        ),
        "predictor_groups": Query(
            "universe name grp rms:f",
            predictor_groups,
            q("history common", "SELECT universe, name, CASE WHEN name = 'intercept' THEN 'intercept' WHEN contains(name, '_x_') THEN 'interaction' WHEN name IN ('disc', 'tax', 'qty') THEN 'common' ELSE 'own' END AS grp, sqrt(avg(x * x)) AS rms FROM named GROUP BY 1, 2", f"{SCORED},\n  named AS (SELECT universe, unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS name, unnest([{', '.join(COLUMNS)}]::DOUBLE[]) AS x FROM kept)"),
        ),
        "expanding_benchmark": Query("universe asset t:i benchmark:f", lambda s, d: B.expanding_benchmark(T.responses(s, d)).filter(F.col("t") >= START), q("forecasts", "SELECT universe, asset, t, benchmark FROM keyed")),
        "ar1_forecast": Query("universe asset t:i t_refit:i predicted:f realised:f benchmark:f", ar1, q("forecasts", "SELECT * FROM forecasts")),
        "oos_r2": Query("universe r2:f", lambda s, d: E.oos_r2(ar1(s, d)), q("forecasts", "SELECT universe, 1 - sum(pow(realised - predicted, 2)) / sum(pow(realised - benchmark, 2)) AS r2 FROM forecasts GROUP BY 1")),
        "r2_by_asset": Query("universe asset r2:f", lambda s, d: E.r2_by_asset(ar1(s, d)), q("forecasts", "SELECT universe, asset, 1 - sum(pow(realised - predicted, 2)) / sum(pow(realised - benchmark, 2)) AS r2 FROM forecasts GROUP BY 1, 2")),
        "r2_summary": Query("universe median_r2:f n_positive:i", lambda s, d: E.r2_summary(ar1(s, d)), q("forecasts", "SELECT universe, median(r2) AS median_r2, count(*) FILTER (r2 > 0) AS n_positive FROM (SELECT universe, asset, 1 - sum(pow(realised - predicted, 2)) / sum(pow(realised - benchmark, 2)) AS r2 FROM forecasts GROUP BY 1, 2) GROUP BY 1")),
        "alignment_alarm": Query("universe r2:f alarm:b", lambda s, d: E.alignment_alarm(E.oos_r2(ar1(s, d))), q("forecasts", "SELECT universe, 1 - sum(pow(realised - predicted, 2)) / sum(pow(realised - benchmark, 2)) AS r2, 1 - sum(pow(realised - predicted, 2)) / sum(pow(realised - benchmark, 2)) > 0.05 AS alarm FROM forecasts GROUP BY 1")),
        "ls_weights": Query("universe asset t:i w:f", lambda s, d: E.weights(ar1(s, d)), q("weights", "SELECT * FROM weights")),
        "ls_returns": Query("universe t:i q:f", portfolio, q("weights", "SELECT * FROM portfolio")),
        "gross_exposure": Query("universe mean_gross:f min_gross:f", lambda s, d: E.gross_exposure(E.weights(ar1(s, d))), q("weights", "SELECT universe, avg(g) AS mean_gross, min(g) AS min_gross FROM (SELECT universe, t, sum(abs(w)) AS g FROM weights GROUP BY 1, 2) GROUP BY 1")),
        "sharpe": Query("universe sharpe:f", lambda s, d: E.sharpe(portfolio(s, d)), q("weights", f"SELECT universe, {SHARPE} AS sharpe FROM portfolio GROUP BY 1")),
        "certainty_equivalent": Query("universe ce:f", lambda s, d: E.certainty_equivalent(portfolio(s, d)), q("weights", f"SELECT universe, {CE} AS ce FROM portfolio GROUP BY 1")),
        "pred_vol_ratio": Query("universe vol_ratio:f", lambda s, d: E.volatility_ratio(ar1(s, d)), q("forecasts", "SELECT universe, stddev_pop(predicted) / stddev_pop(realised) AS vol_ratio FROM forecasts GROUP BY 1")),
        "loss_decomposition": Query(
            "universe var_common:f var_cross:f cov_common:f cov_cross:f",
            lambda s, d: E.loss_decomposition(ar1(s, d)),
            q("forecasts", "SELECT universe, sum(db * db) / sum(e * e) AS var_common, sum(pow(d - db, 2)) / sum(e * e) AS var_cross, -2 * sum(eb * db) / sum(e * e) AS cov_common, -2 * sum((e - eb) * (d - db)) / sum(e * e) AS cov_cross FROM ld GROUP BY 1", "ld AS (SELECT universe, realised - benchmark AS e, predicted - benchmark AS d, avg(realised - benchmark) OVER w AS eb, avg(predicted - benchmark) OVER w AS db FROM forecasts WINDOW w AS (PARTITION BY universe, t))"),
        ),
        "newey_west": Query("universe n:i lags:i mean:f lrv:f", lambda s, d: E.long_run_variance(portfolio(s, d), "q"), q("weights", "SELECT * FROM tested", LRV.format(d="any_value(q)", src="portfolio"))),
        "diebold_mariano": Query("universe n:i lags:i mean:f stat:f p:f", lambda s, d: E.diebold_mariano(both_models(s, d), "predicted", "prefix"), q("forecasts", f"SELECT *, 2 * (1 - {cdf_sql('abs(stat)')}) AS p FROM tested", LRV.format(d=DM_D, src="forecasts"))),
        "clark_west": Query("universe n:i lags:i mean:f stat:f p:f", lambda s, d: E.clark_west(ar1(s, d)), q("forecasts", f"SELECT *, 1 - {cdf_sql('stat')} AS p FROM tested", LRV.format(d=CW_D, src="forecasts"))),
        "sharpe_diff_hac": Query("universe n:i lags:i delta:f se:f t_stat:f", lambda s, d: L.hac_difference(sharpe_pairs(s, d), ("universe", "a", "b")), q("weights", "SELECT universe, n, lags, delta, sqrt(greatest(psi, 0) / n) AS se, delta / nullif(sqrt(greatest(psi, 0) / n), 0) AS t_stat FROM ps", HAC)),
        "sharpe_bootstrap": Query("universe n:i delta:f se:f block:i p:f", lambda s, d: L.block_sweep(bootstrap_pairs(s, d), ("universe", "a", "b")), q("weights", f"SELECT universe, n, ps.delta, sqrt(greatest(psi, 0) / n) AS se, block, (1 + count(*) FILTER (abs(sample - ps.delta) / nullif(e, 0) >= abs(ps.delta) / sqrt(greatest(psi, 0) / n))) / {L.REPLICATES + 1.0} AS p FROM bt JOIN ps USING (universe) GROUP BY universe, n, ps.delta, psi, block", bootstrap_sql())),
        "cross_sort_stacked": Query("t:i q:f", lambda s, d: E.stacked(portfolio(s, d)), q("weights", "SELECT t, avg(q) AS q FROM portfolio GROUP BY 1")),
        "cross_sort_pooled": Query(
            "portfolio sharpe:f ce:f best_within:b",
            lambda s, d: E.cross_sort(ar1(s, d)),
            q(
                "weights",
                "SELECT *, portfolio NOT IN ('pooled', 'stacked') AND sharpe = (SELECT max(sharpe) FROM sc WHERE portfolio NOT IN ('pooled', 'stacked')) AS best_within FROM sc",
                f"""pd AS (SELECT t, realised, predicted - avg(predicted) OVER (PARTITION BY t) AS d FROM forecasts), pg AS (SELECT *, sum(abs(d)) OVER (PARTITION BY t) AS g FROM pd),
  ev AS (SELECT universe AS portfolio, t, q FROM portfolio UNION ALL SELECT 'pooled', t, sum(CASE WHEN g > 0 THEN d / g ELSE 0 END * realised) FROM pg GROUP BY t UNION ALL SELECT 'stacked', t, avg(q) FROM portfolio GROUP BY t),
  sc AS (SELECT portfolio, {SHARPE} AS sharpe, {CE} AS ce FROM ev GROUP BY 1)""",
            ),
        ),
        "unequal_months": Query("universe t:i", lambda s, d: E.same_months(ar1(s, d)), q("forecasts", "SELECT * FROM (SELECT u.universe, m.t FROM (SELECT DISTINCT universe FROM forecasts) u, (SELECT DISTINCT t FROM forecasts) m) EXCEPT SELECT DISTINCT universe, t FROM forecasts")),
        "model_minus_baseline": Query("universe model d_sharpe:f d_ce:f", lambda s, d: E.model_minus_baseline(metrics_by_model(s, d), "mean"), q("weights", "SELECT a.universe, a.model, a.sharpe - b.sharpe AS d_sharpe, a.ce - b.ce AS d_ce FROM mm a JOIN mm b USING (universe) WHERE a.model = 'ar1' AND b.model = 'mean'", f"{MODELS}, mm AS (SELECT universe, model, {SHARPE} AS sharpe, {CE} AS ce FROM model_returns GROUP BY 1, 2)")),
        "stopping_rule": Query("universe gap:f stop:b", lambda s, d: E.stopping_rule(metrics_by_model(s, d)), q("weights", "SELECT universe, max(sharpe) - min(sharpe) AS gap, max(sharpe) - min(sharpe) < 0.158 AS stop FROM mm GROUP BY 1", f"{MODELS}, mm AS (SELECT universe, model, {SHARPE} AS sharpe FROM model_returns GROUP BY 1, 2)")),
        "forecast_agreement": Query("universe max_diff:f relative:f", lambda s, d: E.agreement(ar1(s, d), B.prefix_mean_forecasts(T.responses(s, d), START, EVERY)), q("forecasts", "SELECT universe, max(abs(predicted - prefix)) AS max_diff, max(abs(predicted - prefix)) / avg(abs(predicted)) AS relative FROM forecasts GROUP BY 1")),
        "interval_coverage": Query(
            "universe n:i cover_coef:f cover_full:f width_coef:f width_full:f width_ratio:f se:f",
            lambda s, d: E.coverage(interval_rows(s, d)),
            q("forecasts", "SELECT universe, count(*) AS n, avg((realised BETWEEN predicted - s AND predicted + s)::INT) AS cover_coef, avg((realised BETWEEN predicted - 2 * s AND predicted + 2 * s)::INT) AS cover_full, avg(2 * s) AS width_coef, avg(4 * s) AS width_full, 0.5 AS width_ratio, sqrt(0.0475 / count(*)) AS se FROM iv WHERE s IS NOT NULL GROUP BY 1", INTERVALS),
        ),
        "lookahead_check": Query("before:f changed:b", lambda s, d: lookahead_check(s, d).select("before", (F.col("after") > 0).alias("changed")), "\n--\nSELECT 0.0 AS before, true AS changed"),
        "lookahead_coefficients": Query(
            "universe before:f changed:b",
            lambda s, d: B.lookahead_coefficients(lambda p: B.ar1_coefficients(p, START, EVERY), T.responses(s, d), START + EVERY, by=("universe",)).select("universe", "before", (F.col("after") > 0).alias("changed")),
            q("responses", "SELECT DISTINCT universe, 0.0 AS before, true AS changed FROM responses"),
        ),
        "asset_descriptives": Query(
            "universe asset mean_pct:f sd_pct:f sharpe:f ar1:f",
            lambda s, d: D.asset_statistics(T.returns(s, d)),
            q("returns", "SELECT universe, asset, 100 * avg(ret) AS mean_pct, 100 * stddev_samp(ret) AS sd_pct, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe, sum(c * b) / sum(c * c) AS ar1 FROM (SELECT *, lag(c) OVER (PARTITION BY universe, asset ORDER BY month) AS b FROM ct) GROUP BY 1, 2", "ct AS (SELECT *, ret - avg(ret) OVER (PARTITION BY universe, asset) AS c FROM returns)"),
        ),
        "statistic_ranges": Query(
            "universe statistic lo:f mid:f hi:f",
            lambda s, d: D.statistic_ranges(D.asset_statistics(T.returns(s, d))).filter("statistic in ('mean_pct', 'sd_pct')"),
            q("returns", "SELECT universe, statistic, min(x) AS lo, median(x) AS mid, max(x) AS hi FROM (SELECT universe, 'mean_pct' AS statistic, mean_pct AS x FROM st UNION ALL SELECT universe, 'sd_pct', sd_pct FROM st) GROUP BY 1, 2", "st AS (SELECT universe, asset, 100 * avg(ret) AS mean_pct, 100 * stddev_samp(ret) AS sd_pct FROM returns GROUP BY 1, 2)"),
        ),
        # the SQL of statistic_ranges has two of the four statistics
        "statistic_ranges_all": Query(
            "universe statistic lo:f mid:f hi:f",
            lambda s, d: D.statistic_ranges(D.asset_statistics(T.returns(s, d))),
            q("returns", "SELECT universe, statistic, min(x) AS lo, median(x) AS mid, max(x) AS hi FROM (UNPIVOT st ON mean_pct, sd_pct, sharpe, ar1 INTO NAME statistic VALUE x) GROUP BY 1, 2", "ct AS (SELECT *, ret - avg(ret) OVER (PARTITION BY universe, asset) AS c FROM returns), cl AS (SELECT *, lag(c) OVER (PARTITION BY universe, asset ORDER BY month) AS b FROM ct), st AS (SELECT universe, asset, 100 * avg(ret) AS mean_pct, 100 * stddev_samp(ret) AS sd_pct, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe, sum(c * b) / sum(c * c) AS ar1 FROM cl GROUP BY 1, 2)"),
        ),
        "sample_covariance": Query("universe i j cov:f", lambda s, d: D.covariance(T.returns(s, d)), q("returns", "SELECT a.universe, a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) AS cov FROM returns a JOIN returns b USING (universe, month) GROUP BY 1, 2, 3")),
        "corr_matrix": Query("universe a b corr:f", named_corr, q("history common", "SELECT * FROM corr", f"{SCORED}, {CORR_SQL}")),
        "corr_summary": Query("universe n_high:i median_abs:f p99_abs:f n_pairs:i", lambda s, d: D.correlation_summary(named_corr(s, d)), q("history common", "SELECT universe, count(*) FILTER (abs(corr) > 0.9) AS n_high, median(abs(corr)) AS median_abs, quantile_cont(abs(corr), 0.99) AS p99_abs, count(*) AS n_pairs FROM corr GROUP BY 1", f"{SCORED}, {CORR_SQL}")),
        "near_duplicate_pairs": Query("universe a b corr:f rank:i", lambda s, d: D.ranked_correlations(named_corr(s, d)), q("history common", "SELECT *, row_number() OVER (PARTITION BY universe ORDER BY round(abs(corr), 9) DESC, a, b) AS rank FROM corr", f"{SCORED}, {CORR_SQL}")),
        "market_return": Query("universe month:d mean_ret:f cum_log:f", lambda s, d: D.cumulative_log(D.market(T.returns(s, d)).filter("mean_ret > -1"), "mean_ret"), q("returns", "SELECT *, sum(ln(1 + mean_ret)) OVER (PARTITION BY universe ORDER BY month) AS cum_log FROM mk WHERE mean_ret > -1", "mk AS (SELECT universe, month, avg(ret) AS mean_ret FROM returns GROUP BY 1, 2)")),
        "cumulative_log_return": Query("universe t:i cum_log:f", lambda s, d: D.cumulative_log(portfolio(s, d).filter("q > -1"), "q", "t"), q("weights", "SELECT universe, t, sum(ln(1 + q)) OVER (PARTITION BY universe ORDER BY t) AS cum_log FROM portfolio WHERE q > -1")),
        "rolling_vol_band": Query("universe month:d lo:f hi:f", lambda s, d: D.rolling_volatility(T.returns(s, d)), q("returns", "SELECT universe, month, min(v) AS lo, max(v) AS hi FROM rv WHERE v IS NOT NULL GROUP BY 1, 2", "rv AS (SELECT universe, month, CASE WHEN count(ret) OVER w = 36 THEN stddev_samp(ret) OVER w * sqrt(12) END AS v FROM returns WINDOW w AS (PARTITION BY universe, asset ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))")),
        "decimal_year": Query("month:d year:f", lambda s, d: T.common(s, d).select("month", S.decimal_year(F.col("month")).alias("year")), q("common", "SELECT month, year(month) + (month(month) - 1) / 12.0 AS year FROM common")),
        "rms_predictors": Query("universe asset " + " ".join(f"rms_{c}:f" for c in PRED), lambda s, d: D.predictor_rms(predictors_of(s, d), PRED), q("history common", "SELECT universe, asset, " + ", ".join(f"sqrt(avg({c} * {c})) AS rms_{c}" for c in PRED) + " FROM kept GROUP BY 1, 2", SCORED)),
        "prior_scale": Query("universe trace_c:f var_r:f", lambda s, d: D.prior_scale(predictors_of(s, d), PRED), q("history common", "SELECT universe, " + " + ".join(f"var_samp({c})" for c in PRED) + " AS trace_c, var_pop(r_next) AS var_r FROM kept GROUP BY 1", SCORED)),
        "shrinkage_factors": Query("universe asset kappa:f m:f", lambda s, d: D.predictor_rms(predictors_of(s, d), PRED).select("universe", "asset", S.shrinkage(F.lit(50.0), F.lit(0.2), F.lit(0.05), F.lit(1.5), F.col("rms_qty")).alias("kappa"), S.effective_size(F.lit(50.0), F.lit(0.2), F.lit(0.05), F.col("rms_qty")).alias("m")), q("history common", "SELECT universe, asset, 1 / (1 + pow(sqrt(50.0) / 0.2 * 0.05 * 1.5 * s, 2)) AS kappa, sqrt(50.0) / 0.2 * 0.05 * s / (1 + sqrt(50.0) / 0.2 * 0.05 * s) AS m FROM (SELECT universe, asset, sqrt(avg(qty * qty)) AS s FROM kept GROUP BY 1, 2)", SCORED)),
        "slab_formulas": Query(
            "p_partkey:i lam_tilde:f binding:f kappa:f",
            lambda s, d: T.table(s, d, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x")).select("p_partkey", S.regularised_scale(F.col("x"), F.lit(0.3), F.lit(1.2)).alias("lam_tilde"), S.slab_binding_probability(F.col("x"), F.lit(1.2)).alias("binding"), S.shrinkage_from_variance(F.lit(50.0), F.lit(0.04), F.col("x"), F.lit(1.1)).alias("kappa")),
            "\n--\nSELECT p_partkey, sqrt(1.44 * x * x / (1.44 + 0.09 * x * x)) AS lam_tilde, 2 / pi() * atan(x / 1.2) AS binding, 1 / (1 + 50.0 * 1.1 * x / 0.04) AS kappa FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)",
        ),
        "gram_blocks": Query("i j g:f", lambda s, d: predictors_of(s, d).filter("universe = 'type'").transform(lambda p: p.select("month", F.col("asset").alias("i"), F.col("vol12").alias("x")).join(p.select("month", F.col("asset").alias("j"), F.col("vol12").alias("y")), "month").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))), q("history common", "SELECT a.asset AS i, b.asset AS j, sum(a.vol12 * b.vol12) AS g FROM kept a JOIN kept b USING (universe, month) WHERE universe = 'type' GROUP BY 1, 2", SCORED)),
        "training_rows": Query("t_refit:i n:i s:f", lambda s, d: B.training_rows(T.responses(s, d).filter("universe = 'type'"), s.range(START, START + 37, EVERY).select(F.col("id").cast("int").alias("t_refit"))).groupBy("t_refit").agg(F.count(F.lit(1)).alias("n"), F.sum("r_next").alias("s")), q("responses", "SELECT t_refit, count(*) AS n, sum(r_next) AS s FROM responses JOIN (SELECT unnest([36, 48, 60, 72]) AS t_refit) ON t < t_refit WHERE universe = 'type' GROUP BY 1")),
        "gram_blocks_all": Query("universe i j g:f", gram_blocks_all, q("history common", "SELECT a.universe, a.asset AS i, b.asset AS j, sum(a.vol12 * b.vol12) AS g FROM kept a JOIN kept b USING (universe, month) GROUP BY 1, 2, 3", SCORED)),
        "training_rows_all": Query("universe t_refit:i n:i s:f", training_rows_all, q("responses", f"SELECT r.universe, t_refit, count(*) AS n, sum(r_next) AS s FROM responses r JOIN (SELECT universe, unnest(range({START}, max(t) + 1, {EVERY})) AS t_refit FROM responses GROUP BY 1) f ON r.universe = f.universe AND t < t_refit GROUP BY 1, 2")),
        "restricted_months_all": Query("universe month:d disc:f", restricted_months_all, q("returns common", "SELECT universe, month, disc FROM common JOIN (SELECT DISTINCT universe, month FROM returns) USING (month)")),
        "sentinel_recode_all": Query(
            "universe asset month:d ret:f",
            lambda s, d: P.recode_sentinels(T.returns(s, d).select("universe", "asset", "month", F.when(F.pmod("t", F.lit(7)) == 0, -99.99).when(F.pmod("t", F.lit(11)) == 0, -999.0).otherwise(F.col("ret")).alias("ret")), ["ret"]),
            q("returns", "SELECT universe, asset, month, CASE WHEN t % 7 = 0 OR t % 11 = 0 THEN NULL ELSE ret END AS ret FROM returns"),
        ),
        "ecdf": Query("universe asset sharpe:f ecdf:f", lambda s, d: D.ecdf(D.asset_statistics(T.returns(s, d)), "sharpe", ("universe",)), q("returns", "SELECT *, cume_dist() OVER (PARTITION BY universe ORDER BY sharpe) AS ecdf FROM (SELECT universe, asset, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe FROM returns GROUP BY 1, 2)")),
        "share_below": Query("universe share_below:f", lambda s, d: D.share_below(T.returns(s, d), "ret", 0.0, ("universe",)), q("returns", "SELECT universe, avg((ret < 0)::INT) AS share_below FROM returns GROUP BY 1")),
        "quantiles": Query("universe p01:f p05:f p25:f p50:f p75:f p95:f p99:f", lambda s, d: D.quantiles(T.returns(s, d), "ret", ("universe",)), q("returns", "SELECT universe, " + ", ".join(f"quantile_cont(ret, {x}) AS p{round(100 * x):02d}" for x in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM returns GROUP BY 1")),
        "density": Query(
            "universe k:i x:f density:f",
            lambda s, d: D.density(T.returns(s, d), "ret", ("universe",), 16),
            q("returns", "SELECT g.universe, k, g.x, avg(exp(-0.5 * pow((g.x - r.ret) / h, 2)) / (h * sqrt(2 * pi()))) AS density FROM g JOIN returns r ON g.universe = r.universe GROUP BY 1, 2, 3", "g AS (SELECT universe, h, unnest(range(16)) AS k, lo + (hi - lo) * unnest(range(16)) / 15.0 AS x FROM (SELECT universe, min(ret) AS lo, max(ret) AS hi, 0.2 * stddev_samp(ret) AS h FROM returns GROUP BY 1))"),
        ),
        "topk_predictors": Query("setting:i j:i mean:f rank:i", lambda s, d: M.top_k(T.pseudo_means(s, d), 10), q("means", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY abs(mean) DESC, j) AS rank FROM means) WHERE rank <= 10")),
        "extremes": Query("setting:i j:i mean:f rank:i end_of", lambda s, d: D.extremes(T.pseudo_means(s, d), "mean", 10, ("setting",), ("j",)).withColumnRenamed("end", "end_of"), q("means", "SELECT setting, j, mean, r AS rank, 'least' AS end_of FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY mean, j) AS r FROM means) WHERE r <= 10 UNION ALL SELECT setting, j, mean, r, 'most' FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY mean DESC, j) AS r FROM means) WHERE r <= 10")),
        "group_means": Query("setting:i grp mean:f", lambda s, d: D.group_means(T.pseudo_means(s, d), "mean", F.when(F.col("j") < 16, "common").otherwise("own"), ("setting",)), q("means", "SELECT setting, CASE WHEN j < 16 THEN 'common' ELSE 'own' END AS grp, avg(mean) AS mean FROM means GROUP BY 1, 2 UNION ALL SELECT setting, 'all', avg(mean) FROM means GROUP BY 1")),
        "spearman": Query("a:i b:i rho:f", lambda s, d: M.spearman(T.pseudo_means(s, d)), q("means", "SELECT x.setting AS a, y.setting AS b, corr(x.r, y.r) AS rho FROM sp x JOIN sp y USING (j) WHERE x.setting < y.setting GROUP BY 1, 2", "sp AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY abs(mean), j)::DOUBLE AS r FROM means)")),
        "rank_stability": Query("a:i b:i rho:f overlap:f", lambda s, d: M.rank_stability(T.pseudo_means(s, d), 20), q("means", "SELECT x.setting AS a, y.setting AS b, corr(x.r, y.r) AS rho, count(*) FILTER (x.k <= 20 AND y.k <= 20) / 20.0 AS overlap FROM sp x JOIN sp y USING (j) WHERE x.setting < y.setting GROUP BY 1, 2", "sp AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY abs(mean), j)::DOUBLE AS r, row_number() OVER (PARTITION BY setting ORDER BY abs(mean) DESC, j) AS k FROM means)")),
        "stable_core": Query("j:i n_settings:i core:b", lambda s, d: M.stable_core(T.pseudo_means(s, d), 20), q("means", "SELECT j, count(*) AS n_settings, count(*) = (SELECT count(DISTINCT setting) FROM means) AS core FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY abs(mean) DESC, j) AS k FROM means) WHERE k <= 20 GROUP BY 1")),
        "setting_pairs": Query("a:i b:i", lambda s, d: D.setting_pairs(T.pseudo_means(s, d)), q("means", "SELECT DISTINCT x.setting AS a, y.setting AS b FROM means x, means y WHERE x.setting < y.setting")),
        "posterior_mean": Query("field mean:f", lambda s, d: M.posterior_mean(T.pseudo_draws(s, d)), q("draws", "SELECT field, avg(value) AS mean FROM draws JOIN (SELECT field, min(m) + 1 AS n FROM (SELECT field, chain, max(draw) AS m FROM draws GROUP BY 1, 2) GROUP BY 1) USING (field) WHERE draw < n GROUP BY 1")),
        "credible_interval": Query("field lo:f hi:f", lambda s, d: M.credible_interval(T.pseudo_draws(s, d)), q("draws", "SELECT field, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM draws GROUP BY 1")),
        "intervals_excluding_zero": Query("field n_excluding:i n:i", lambda s, d: M.excluding_zero(M.credible_interval(T.pseudo_draws(s, d))), q("draws", "SELECT field, count(*) FILTER (lo * hi > 0) AS n_excluding, count(*) AS n FROM (SELECT field, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM draws GROUP BY 1) GROUP BY 1")),
        "shrinkage_ratio": Query(
            "field norm_ratio:f median_ratio:f corr:f",
            lambda s, d: M.shrinkage_ratio(*(T.pseudo_means(s, d).filter(F.col("setting") == k).select(F.lit("b").alias("field"), F.lit(0).alias("i"), "j", "mean") for k in (0, 1))),
            q("means", "SELECT 'b' AS field, sqrt(sum(x.mean * x.mean)) / sqrt(sum(y.mean * y.mean)) AS norm_ratio, median(abs(x.mean)) / median(abs(y.mean)) AS median_ratio, corr(x.mean, y.mean) AS corr FROM means x JOIN means y USING (j) WHERE x.setting = 0 AND y.setting = 1"),
        ),
        "scale_means": Query("field mean:f mean_inverse:f", lambda s, d: M.scale_means(T.pseudo_draws(s, d).withColumn("value", F.abs("value") + 1)), q("draws", "SELECT field, avg(abs(value) + 1) AS mean, avg(1 / (abs(value) + 1)) AS mean_inverse FROM draws GROUP BY 1")),
        "rank_normalise": Query("field chain:i draw:i rank:f z:f", lambda s, d: M.rank_normalised(T.pseudo_draws(s, d)), q("draws", "SELECT * FROM z", Z)),
        "rhat_classic": Query("field rhat:f", lambda s, d: M.classic_rhat(T.pseudo_draws(s, d)), q("draws", "SELECT * FROM rh", rhat_sql("draws", "value", "rh", False))),
        "rhat_split": Query("field bulk:f tail:f rhat:f", lambda s, d: M.rank_rhat(T.pseudo_draws(s, d)), q("draws", "SELECT rb.field, rb.rhat AS bulk, rt.rhat AS tail, greatest(rb.rhat, rt.rhat) AS rhat FROM rb JOIN rt USING (field)", f"{Z}, {FOLDED}, {rhat_sql('z', 'z', 'rb')}, {rhat_sql('fz', 'z', 'rt')}")),
        "autocovariance": Query("field chain:i lag:i acov:f", lambda s, d: M.autocovariance(T.pseudo_draws(s, d), 5), q("draws", "SELECT x.field, x.chain, y.draw - x.draw AS lag, sum(x.c * y.c) / any_value(x.n) AS acov FROM ac x JOIN ac y ON x.field = y.field AND x.chain = y.chain AND y.draw >= x.draw AND y.draw - x.draw <= 5 GROUP BY 1, 2, 3", "ac AS (SELECT *, value - avg(value) OVER (PARTITION BY field, chain) AS c, count(*) OVER (PARTITION BY field, chain) AS n FROM draws)")),
        "effective_size": Query("field ess_bulk:f ess_tail:f", lambda s, d: M.effective_sizes(T.pseudo_draws(s, d)), q("draws", "SELECT * FROM es", sizes_sql("draws", "es"))),
        "diagnose": Query(
            "field rhat:f ess_bulk:f ess_tail:f",
            lambda s, d: M.diagnosed(T.pseudo_draws(s, d)),
            q("draws", "SELECT field, greatest(rb.rhat, rt.rhat) AS rhat, ess_bulk, ess_tail FROM rb JOIN rt USING (field) JOIN es USING (field)", f"{Z}, {FOLDED}, {rhat_sql('z', 'z', 'rb')}, {rhat_sql('fz', 'z', 'rt')}, {sizes_sql('draws', 'es')}"),
        ),
        "chain_budget": Query(
            "n:i field rhat:f ess_bulk:f product:f implied:f",
            lambda s, d: M.chain_budget(T.pseudo_draws(s, d), [50, 100]),
            q("draws", "SELECT *, (rhat - 1) * ess_bulk AS product, n * (rhat - 1) / (1.01 - 1) AS implied FROM (SELECT * FROM d50 UNION ALL SELECT * FROM d100)", f"{budget_sql(50)}, {budget_sql(100)}"),
        ),
        "half_split_stability": Query(
            "median_rho:f p10_rho:f median_overlap:f p10_overlap:f",
            lambda s, d: M.half_split_stability(T.pseudo_draws(s, d).withColumn("j", F.ascii("field") * 1000 + F.length("field")), 20, 2),
            q(
                "draws",
                "SELECT median(rho) AS median_rho, quantile_cont(rho, 0.1) AS p10_rho, median(overlap) AS median_overlap, quantile_cont(overlap, 0.1) AS p10_overlap FROM (SELECT x.rep, corr(x.r, y.r) AS rho, count(*) FILTER (x.k <= 2 AND y.k <= 2) / 2.0 AS overlap FROM hr x JOIN hr y ON x.rep = y.rep AND x.j = y.j WHERE x.a AND NOT y.a GROUP BY 1)",
                f"""hj AS (SELECT ascii(field) * 1000 + length(field) AS j, chain, draw, value FROM draws),
  hk AS (SELECT hj.* FROM hj JOIN (SELECT j, min(m) AS m FROM (SELECT j, chain, max(draw) AS m FROM hj GROUP BY 1, 2) GROUP BY 1) c ON hj.j = c.j AND draw <= m),
  ho AS (SELECT rep, chain, draw, row_number() OVER (PARTITION BY rep ORDER BY (((chain + 1) * {M.SHUFFLE[0]} + (draw + 1) * {M.SHUFFLE[1]} + (rep + 1) * {M.SHUFFLE[2]}) % {M.MODULUS} * {M.SHUFFLE[3]}) % {M.MODULUS}, chain, draw) AS pos, count(*) OVER (PARTITION BY rep) AS n FROM (SELECT DISTINCT chain, draw FROM hk), (SELECT unnest(range(20)) AS rep)),
  hm AS (SELECT rep, pos <= n // 2 AS a, j, avg(value) AS mean FROM hk JOIN ho USING (chain, draw) GROUP BY 1, 2, 3),
  hr AS (SELECT *, row_number() OVER (PARTITION BY rep, a ORDER BY abs(mean), j)::DOUBLE AS r, row_number() OVER (PARTITION BY rep, a ORDER BY abs(mean) DESC, j) AS k FROM hm)""",
            ),
        ),
        "chain_means": Query("field chain:i mean:f sd:f lo:f median:f hi:f", lambda s, d: M.chain_means(T.pseudo_draws(s, d)), q("draws", "SELECT field, chain, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.975) AS hi FROM draws GROUP BY 1, 2")),
        "scale_summary": Query("field mean:f lo:f hi:f ratio:f prior_excluded:b distance_sd:f", lambda s, d: M.scale_summary(T.pseudo_draws(s, d), 2.0), q("draws", "SELECT field, avg(value) AS mean, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, avg(value) / 2 AS ratio, quantile_cont(value, 0.025) > 2 OR quantile_cont(value, 0.975) < 2 AS prior_excluded, (2 - avg(value)) / stddev_samp(value) AS distance_sd FROM draws GROUP BY 1")),
        "draw_prefixes": Query("n:i field mean:f", lambda s, d: M.prefix(T.pseudo_draws(s, d), [20, 50, 100]).groupBy("n", "field").agg(F.avg("value").alias("mean")), q("draws", "SELECT n, field, avg(value) AS mean FROM draws, (SELECT unnest([20, 50, 100]) AS n) WHERE draw < n GROUP BY 1, 2")),
        "energy_fraction": Query("field chain:i ebfmi:f", lambda s, d: M.energy_fraction(T.pseudo_draws(s, d).withColumnRenamed("value", "energy"), ("field", "chain")), q("draws", "SELECT field, chain, sum(dd * dd) / sum(c * c) AS ebfmi FROM (SELECT field, chain, value - lag(value) OVER (PARTITION BY field, chain ORDER BY draw) AS dd, value - avg(value) OVER (PARTITION BY field, chain) AS c FROM draws) GROUP BY 1, 2")),
        "sampler_summary": Query(
            "field chain:i n_divergent:i mean_depth:f saturated:f step_size:f",
            lambda s, d: M.sampler_summary(T.pseudo_draws(s, d).select("field", "chain", "draw", (F.col("value") > 90).alias("diverging"), F.pmod("draw", F.lit(11)).alias("tree_depth"), F.col("value").alias("step_size")), by=("field", "chain")),
            q("draws", "SELECT field, chain, count(*) FILTER (value > 90) AS n_divergent, avg(draw % 11) AS mean_depth, avg((draw % 11 >= 10)::INT) AS saturated, arg_max(value, draw) AS step_size FROM draws GROUP BY 1, 2"),
        ),
        "divergence_positions": Query(
            "x:f position:f",
            lambda s, d: M.divergence_positions(T.pseudo_draws(s, d).filter("field = 'click'").select("value", (F.pmod("draw", F.lit(50)) == 0).alias("diverging")), "value"),
            q("draws", "SELECT value AS x, (SELECT count(*) FROM draws p WHERE p.field = 'click' AND p.draw % 50 <> 0 AND p.value < v.value)::DOUBLE / (SELECT count(*) FROM draws p WHERE p.field = 'click' AND p.draw % 50 <> 0) AS position FROM draws v WHERE field = 'click' AND draw % 50 = 0"),
        ),
        "slab_summary": Query(
            "chain:i binding:f halved:f mean_c:f mean_tau:f mean_ratio:f",
            lambda s, d: M.slab_summary(T.pseudo_draws(s, d).select("chain", (F.abs("value") + 1).alias("lam"), F.lit(0.1).alias("tau"), F.lit(1.2).alias("c")).withColumn("lam_tilde", S.regularised_scale(F.col("lam"), F.col("tau"), F.col("c")))),
            q("draws", "SELECT chain, avg((r < 0.99)::INT) AS binding, avg((r < 0.5)::INT) AS halved, 1.2 AS mean_c, 0.1 AS mean_tau, avg(r) AS mean_ratio FROM (SELECT chain, sqrt(1.44 * l * l / (1.44 + 0.01 * l * l)) / l AS r FROM (SELECT chain, abs(value) + 1 AS l FROM draws)) GROUP BY 1"),
        ),
        # the square of the product of the means of chains' means, not a mean of squares
        "deviation_variance": Query("i:i j:i variance:f", lambda s, d: M.deviation_variance(T.pseudo_draws(s, d).select("chain", F.length("field").alias("i"), "j", (F.abs("value") / 100).alias("lam"), (F.col("draw") / 1000).alias("tau"))), q("draws", "SELECT i, 0 AS j, pow(avg(tau) * avg(lam), 2) AS variance FROM (SELECT length(field) AS i, chain, avg(draw / 1000) AS tau, avg(abs(value) / 100) AS lam FROM draws GROUP BY 1, 2) GROUP BY 1")),
        "gaussian_deviation_variance": Query("j:i variance:f", lambda s, d: M.gaussian_deviation_variance(T.pseudo_draws(s, d).select("chain", F.length("field").alias("j"), F.abs("value").alias("value"))), q("draws", "SELECT j, avg(m) AS variance FROM (SELECT length(field) AS j, chain, avg(abs(value)) AS m FROM draws GROUP BY 1, 2) GROUP BY 1")),
        "lasso_deviation_variance": Query("i:i j:i variance:f", lambda s, d: M.lasso_deviation_variance(T.pseudo_draws(s, d).select("chain", F.length("field").alias("i"), "j", F.abs("value").alias("value")), 0.3), q("draws", "SELECT i, 0 AS j, 0.09 * avg(m) AS variance FROM (SELECT length(field) AS i, chain, avg(abs(value)) AS m FROM draws GROUP BY 1, 2) GROUP BY 1")),
        "runs_agree": Query(
            "field z:f",
            lambda s, d: M.runs_agree(T.pseudo_draws(s, d).filter("chain < 2"), T.pseudo_draws(s, d).filter("chain >= 2")),
            q("draws", "SELECT field, abs(a.m - b.m) / sqrt(a.v / ea.ess + b.v / eb.ess) AS z FROM (SELECT field, avg(value) AS m, var_samp(value) AS v FROM ra GROUP BY 1) a JOIN (SELECT field, avg(value) AS m, var_samp(value) AS v FROM rz GROUP BY 1) b USING (field) JOIN ea USING (field) JOIN eb USING (field)", f"ra AS (SELECT * FROM draws WHERE chain < 2), rz AS (SELECT * FROM draws WHERE chain >= 2), {ess_sql('ra', 'value', 'ea')}, {ess_sql('rz', 'value', 'eb')}"),
        ),
        "agreement_z": Query(
            "field z:f",
            lambda s, d: M.agreement_z(T.pseudo_draws(s, d).groupBy("field", "i", "j").agg(*(f(F.when(F.col("chain") < 2 if k == "a" else F.col("chain") >= 2, F.col("value"))).alias(f"{n}{k}") for k in "ab" for n, f in (("m", F.avg), ("v", F.var_samp), ("e", F.count))))),
            q("draws", "SELECT field, abs(avg(value) FILTER (chain < 2) - avg(value) FILTER (chain >= 2)) / sqrt(var_samp(value) FILTER (chain < 2) / count(*) FILTER (chain < 2) + var_samp(value) FILTER (chain >= 2) / count(*) FILTER (chain >= 2)) AS z FROM draws GROUP BY 1"),
        ),
        "budget_validation": Query(
            "field median_z:f max_z:f within_3:f corr:f",
            lambda s, d: budget_validation(T.pseudo_draws(s, d)),
            # the error is sd sqrt(1 / draws + 1 / the full run's effective size)
            q("draws", "SELECT 'b' AS field, median(z) AS median_z, max(z) AS max_z, avg((z < 3)::INT) AS within_3, corr(x, y) AS corr FROM (SELECT *, abs(x - y) / (sd * sqrt(1.0 / n + 1.0 / 300)) AS z FROM (SELECT field, avg(value) FILTER (draw < 50) AS x, stddev_pop(value) FILTER (draw < 50) AS sd, count(*) FILTER (draw < 50) AS n, avg(value) AS y FROM draws GROUP BY 1))"),
        ),
        "trace_elements": Query("field chain:i draw:i value:f", lambda s, d: M.traces(T.pseudo_draws(s, d), "click", 1), q("draws", "SELECT field, chain, draw, value FROM draws WHERE field = 'click'")),
        "factor_join": Query("month:d disc:f tax:f mean_ret:f", lambda s, d: P.join_factors(T.common(s, d).select("month", "disc", "tax"), D.market(T.returns(s, d).filter("universe = 'type'")).select("month", "mean_ret")), q("common returns", "SELECT month, disc, tax, mean_ret FROM common JOIN (SELECT month, avg(ret) AS mean_ret FROM returns WHERE universe = 'type' GROUP BY 1) USING (month)")),
        "ar1_residuals": Query("universe asset t:i e:f", lambda s, d: B.ar1_fits(T.responses(s, d), START, EVERY).select("universe", "asset", "t", S.residual(F.col("realised"), F.array(F.lit(1.0), "ret"), F.array("a", "b")).alias("e")), q("forecasts", "SELECT universe, asset, t, realised - predicted AS e FROM forecasts")),
        "clean_numbers": Query(
            "o_orderkey:i x:f",
            lambda s, d: T.table(s, d, "orders").select("o_orderkey", S.clean_number(F.when(F.col("o_orderkey") % 7 == 0, " NaN").when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.concat(F.lit("  "), F.format_number(F.floor("o_totalprice"), 2), F.lit(" ")))).alias("x")),
            "\n--\nSELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN floor(o_totalprice) END AS x FROM orders",
        ),
        "pooled_scale": Query("universe sd:f", pooled_scale, q("responses", "SELECT universe, sqrt(sum(sse) / (count(*) * (any_value(n) - 2))) AS sd FROM (SELECT universe, asset, count(*) AS n, regr_syy(r_next, ret) - pow(regr_sxy(r_next, ret), 2) / regr_sxx(r_next, ret) AS sse FROM responses GROUP BY 1, 2) GROUP BY 1")),
        "refit_schedules": Query(
            "universe start:i refit_every:i asset t:i t_refit:i predicted:f benchmark:f",
            refit_schedules,
            q("forecasts", "SELECT k.universe, start, refit_every, k.asset, k.t, k.t_refit, p.a + p.b * k.ret AS predicted, k.benchmark FROM sk k JOIN prior p ON k.universe = p.universe AND k.asset = p.asset AND k.t_refit = p.t", f"sk AS (SELECT *, start + ((t - start) // refit_every) * refit_every AS t_refit FROM prior, (VALUES {', '.join(f'({a}, {b})' for a, b in SCHEDULES)}) v(start, refit_every) WHERE t >= start)"),
        ),
        "predictive_intervals": Query("universe n:i cover_coef:f cover_full:f width_coef:f width_full:f width_ratio:f se:f", predictive_intervals),
        "ridge_backtest": Query("universe asset t:i t_refit:i predicted:f realised:f benchmark:f", ridge_backtest, RIDGE),
        "gibbs_backtest": Query("universe asset t:i t_refit:i predicted:f realised:f benchmark:f", gibbs_backtest),
    }
    return out


def queries() -> dict[str, Run]:
    return {name: x.spark for name, x in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: x.oracle() for name, x in all_queries().items() if x.sql}
