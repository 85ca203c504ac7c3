"""Command line: python -m fathomgrid.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from fathomgrid.models import fitters
from fathomgrid.operators import backtest as B
from fathomgrid.operators import descriptive as D
from fathomgrid.operators import draws as M
from fathomgrid.operators import evaluation as E
from fathomgrid.operators import least_squares as R
from fathomgrid.operators import sharpe_test as L
from fathomgrid.plans import dataset
from fathomgrid.session import local
from fathomgrid.sources import stores


def build(spark, a):
    """Panels of universes from raw files."""
    for u in a.universe:
        frames = dataset.clean(spark, u, a.folder, a.five, a.momentum, a.macro, a.drop)
        panel, names = dataset.build(*frames, a.stabilisation)
        stores.save_panel(panel, f"{a.store}/{u}", names, a.drop)


# Names of the prior's settings by model, and of the options that give them.
PRIORS = {
    "gaussian": {"prior": "prior", "target_r2": "target_r2"},
    "lasso": {"target_r2": "target_r2", "multiplier": "lambda_multiplier"},
    "horseshoe": {"target_r2": "target_r2", "p0": "p0", "n_choice": "n_choice"},
    "regularised": {"target_r2": "target_r2", "p0": "p0", "n_choice": "n_choice", "nu": "nu", "slab_scale": "slab_scale"},
}


def prior_settings(a) -> dict:
    """The options that were given; one that the model's prior doesn't have is refused."""
    given = {o: getattr(a, o) for m in PRIORS.values() for o in m.values() if getattr(a, o) is not None}
    own = PRIORS[a.model]
    if unknown := set(given) - set(own.values()):
        raise SystemExit(f"{a.model} has no {', '.join(sorted(unknown))}")
    return {name: given[o] for name, o in own.items() if o in given}


def fit(spark, a):
    """Chains of a model on a whole panel."""
    if a.sequential and a.model != "gaussian":
        raise SystemExit("only the gaussian model has a sequential scan")
    if a.sampler == "nuts" and a.model not in ("horseshoe", "regularised"):
        raise SystemExit("NUTS samples the horseshoe and the regularised model")
    _, r, f = B.dense(stores.load_panel(spark, f"{a.store}/{a.universe}"))
    out = fitters.chains(spark, a.model, r, f, fitters.prior_of(a.model, r, f, **prior_settings(a)), a.chains, a.draws, a.burn, a.seed, a.sampler, **({} if a.sampler == "nuts" else {"blocked": not a.sequential}))
    for name, value in (("setting", a.setting), ("model", a.model), ("universe", a.universe)):
        out = out.withColumn(name, F.lit(value))
    stores.save_draws(out, f"{a.store}/draws")


def diagnose(spark, a):
    """Convergence of stored chains, their scales, local variances and rankings, and how far other settings agree.

    A setting is NAME or MODEL:NAME; the first one's chains are diagnosed, the others compared by their rankings.
    """
    path = f"{a.store}/{a.universe}"
    named = [s.rpartition(":") for s in a.setting]
    load = lambda model, setting: stores.load_chains(spark, f"{a.store}/draws", a.universe, model or a.model, setting)
    every = load(named[0][0], named[0][2])
    d = every.filter(F.col("field").isin(a.fields))
    M.diagnosis_summary(M.diagnosed(d)).show(100, False)
    M.excluding_zero(M.credible_interval(d)).show(100, False)
    if not (stats := fitters.sampler_statistics(every)).isEmpty():
        M.sampler_summary(stats).join(M.energy_fraction(stats), "chain").show(100, False)
    b_bar = every.filter("field = 'b_bar'")
    M.half_split_stability(b_bar, a.repetitions, a.top).show()
    means = None
    for model, _, setting in named:
        one = M.posterior_mean(load(model, setting).filter("field = 'b_bar'")).withColumn("setting", F.lit(f"{model or a.model}:{setting}"))
        means = one if means is None else means.unionByName(one)
    M.top_k(means, a.top).show(a.top * len(named), False)
    if len(named) > 1:
        M.rank_stability(means, a.top).show(100, False)
        M.stable_core(means, a.top).filter("core").show(1000, False)
    scales = every.filter(F.col("field").isin("tau", "lam", "c") & (F.col("i") == 0) & (F.col("j") == 0))
    M.chain_means(scales).show(100, False)
    _, r, f = B.dense(stores.load_panel(spark, path))
    prior = fitters.prior_of(a.model, r, f, **prior_settings(a))
    if a.model in ("horseshoe", "regularised"):
        M.scale_summary(every.filter("field = 'tau'"), prior.tau_0).show(1, False)
    if a.model == "regularised":
        scalar = every.filter("field in ('tau', 'c')").groupBy("chain", "draw").pivot("field", ["tau", "c"]).agg(F.first("value"))
        local = every.filter("field in ('lam_local', 'lam_tilde')").groupBy("chain", "draw", "i", "j").pivot("field", ["lam_local", "lam_tilde"]).agg(F.first("value"))
        M.slab_summary(local.withColumnRenamed("lam_local", "lam").join(scalar, ["chain", "draw"])).show(100, False)
    variance = deviation_variance(a.model, every, prior)
    if variance is not None:
        names = stores.load_predictor_names(spark, path, a.universe, f.shape[2])
        group = F.element_at(F.array(*(F.lit(group_of(n)) for n in names)), F.col("j") + 1)
        D.group_means(variance.withColumn("setting", F.lit(a.setting[0])), "variance", group, ("setting",)).show(10, False)


def deviation_variance(model, every, prior):
    """Mean prior variance of each deviation (j, variance[, i]) of a model, where its draws have what that needs."""
    if model == "gaussian":
        return M.gaussian_deviation_variance(every.filter("field = 'Delta_b_diag'"))
    if model == "lasso":
        return M.lasso_deviation_variance(t, prior.s) if not (t := every.filter("field = 'tau2_mean'")).isEmpty() else None
    lam = every.filter(F.col("field") == ("lam_local" if model == "horseshoe" else "lam_tilde"))
    tau = every.filter("field = 'tau'").select("chain", "draw", F.col("value").alias("tau"))
    return M.deviation_variance(lam.withColumnRenamed("value", "lam").join(tau, ["chain", "draw"]))


def group_of(name: str) -> str:
    """Group of a predictor by its name."""
    if name == "intercept":
        return name
    return "interaction" if "_x_" in name else "common" if name in (*dataset.MACRO, *dataset.FACTORS) else "own"


def backtest(spark, a):
    """An expanding-window backtest, after the look-ahead check, and its metrics."""
    panel = stores.load_panel(spark, f"{a.store}/{a.universe}")
    if a.model in ("ols", "ridge"):  # of any size: nothing is gathered
        penalty = float(a.model == "ridge")
        keys = tuple(k for k in ("universe", "asset") if k in panel.columns)
        f = R.expanding_window(panel, a.start, a.refit_every, penalty, keys)
        if not a.skip_lookahead:
            B.assert_unchanged(lambda p: R.expanding_window(p, a.start, 5 * a.refit_every, penalty, keys), panel, a.start + 5 * a.refit_every, 5 * a.refit_every)
    else:
        fit = fitters.fitter(a.model, draws=a.draws, burn=a.burn)
        if not a.skip_lookahead:
            B.assert_no_lookahead(fit, panel, a.start + 5 * a.refit_every, a.start, 5 * a.refit_every)
        f = B.expanding_window(panel, fit, a.start, a.refit_every)
    for name, value in (("setting", a.setting), ("model", a.model)):
        f = f.withColumn(name, F.lit(value))
    stores.save_backtest(f, f"{a.store}/backtests")
    f = stores.load_backtest(spark, f"{a.store}/backtests", a.universe, a.model, a.setting)
    q = E.portfolio(E.weights(f))
    for df in (E.alignment_alarm(E.oos_r2(f)), E.r2_summary(f), E.sharpe(q), E.certainty_equivalent(q), E.clark_west(f), E.loss_decomposition(f), E.volatility_ratio(f)):
        print(json.dumps(df.first().asDict()))


def intervals(spark, a):
    """Coverage of predictive intervals."""
    panel = stores.load_panel(spark, f"{a.store}/{a.universe}")
    rows = B.intervals(panel, fitters.interval_fitter(a.model, draws=a.draws, burn=a.burn), a.start, a.refit_every)
    print(json.dumps(E.coverage(rows.withColumn("universe", F.lit(a.universe))).first().asDict()))


def _forecasts(spark, a, model):
    return spark.read.parquet(f"{a.store}/backtests").filter((F.col("model") == model) & (F.col("setting") == a.setting))


def sharpe_test(spark, a):
    """Pairs of models' Sharpe ratios in each universe and stacked, for each block length."""
    every = None
    for m in sorted({m for p in a.pairs for m in p.split(":")}):
        q = E.portfolio(E.weights(_forecasts(spark, a, m)))
        q = q.unionByName(E.stacked(q).withColumn("universe", F.lit("stacked"))).withColumn("model", F.lit(m))
        every = q if every is None else every.unionByName(q)
    rows = L.compared(every, [tuple(p.split(":")) for p in a.pairs])
    out = L.block_sweep(rows, ("universe", "a", "b"), tuple(a.block), a.replicates, a.seed)
    stores.save_csv(out, a.out) if a.out else out.show(1000, False)


def cross_sort(spark, a):
    """Pooled, stacked and within-universe portfolios of a model."""
    f = _forecasts(spark, a, a.model)
    if not E.same_months(f).isEmpty():
        raise SystemExit("the universes' months differ")
    E.cross_sort(f).show(100, False)


def summary(spark, a):
    """Descriptive statistics of a panel's returns, by asset or their ranges, as LaTeX."""
    stats = D.asset_statistics(stores.load_panel(spark, f"{a.store}/{a.universe}").withColumnRenamed("r_next", "ret"))
    print(stores.latex_table(D.statistic_ranges(stats) if a.ranges else stats, a.decimals))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomgrid", description=__doc__)
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *options):
        c = sub.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        c.set_defaults(run=run)
        c.add_argument("--store", required=True)
        for names, kw in options:
            c.add_argument(names, **kw)

    universe, setting = ("--universe", {"required": True}), ("--setting", {"default": "main"})
    model, seed = ("--model", {"required": True}), ("--seed", {"type": int, "default": 0})
    number = lambda n, d: (n, {"type": int, "default": d})
    real = lambda n: (n, {"type": float, "default": None})
    priors = [("--prior", {"choices": ["default", "rescaled"], "default": None}), real("--target-r2"), real("--lambda-multiplier"), number("--p0", None), ("--n-choice", {"choices": ["T", "NT"], "default": None}), real("--nu"), real("--slab-scale")]
    window = [number("--start", B.START), number("--refit-every", B.REFIT_EVERY), number("--draws", None), number("--burn", None)]
    command(build, ("--universe", {"nargs": "+", "required": True}), *((n, {"required": True}) for n in ("--folder", "--five", "--momentum", "--macro")), ("--drop", {"nargs": "*", "default": []}), number("--stabilisation", dataset.STABILISATION))
    command(fit, universe, model, setting, seed, number("--chains", 4), number("--draws", 3000), number("--burn", 1000), ("--sequential", {"action": "store_true"}), ("--sampler", {"choices": ["gibbs", "nuts"], "default": "gibbs"}), *priors)
    command(diagnose, universe, model, ("--setting", {"nargs": "+", "default": ["main"]}), number("--top", 20), number("--repetitions", 40), ("--fields", {"nargs": "+", "default": ["b_bar", "Sigma", "tau", "lam", "lam_local", "tau2_track", "c"]}), *priors)
    command(backtest, universe, model, setting, *window, ("--skip-lookahead", {"action": "store_true"}))
    command(intervals, universe, model, *window)
    command(sharpe_test, setting, seed, ("--pairs", {"nargs": "+", "required": True}), ("--block", {"nargs": "+", "type": int, "default": [5]}), number("--replicates", L.REPLICATES), ("--out", {"default": ""}))
    command(cross_sort, model, setting)
    command(summary, universe, ("--ranges", {"action": "store_true"}), number("--decimals", 3))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = local(a.cores)
    a.run(spark, a)


if __name__ == "__main__":
    main()
