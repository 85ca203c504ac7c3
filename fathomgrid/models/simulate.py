"""Simulated SUR data with known truth, and calibration over many data sets, one to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import priors
from .fitters import prior_of
from .samplers import run


@dataclass
class Simulated:
    r: np.ndarray
    f: np.ndarray
    b: np.ndarray
    b_bar: np.ndarray
    sigma: np.ndarray

    @property
    def theta(self) -> np.ndarray:
        return self.b - self.b_bar


# Degrees of freedom beyond the dimension, and what is added to the diagonal.
EXTRA, RIDGE = 5, 1e-6


def random_covariance(n: int, rng: np.random.Generator, scale: float = 1.0, extra: int = EXTRA) -> np.ndarray:
    """A Wishart matrix with n + extra degrees of freedom and mean scale * I, kept off the edge by RIDGE * I."""
    x = np.sqrt(scale / (n + extra)) * rng.standard_normal((n + extra, n))
    return x.T @ x + RIDGE * np.eye(n)


def gaussian_deviations(n: int, cov: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return rng.multivariate_normal(np.zeros(len(cov)), cov, size=n)


def sparse_deviations(n: int, cov: np.ndarray, rng: np.random.Generator, zero: float = 0.7, active: float = 1.0) -> np.ndarray:
    """Exactly zero with probability zero, else normal with active times the deviation of its own predictor."""
    sd = active * np.sqrt(np.diag(cov))
    return np.where(rng.random((n, len(cov))) < zero, 0.0, sd * rng.standard_normal((n, len(cov))))


def predictors(n: int, t: int, k: int, rng: np.random.Generator) -> np.ndarray:
    f = rng.standard_normal((n, t, k))
    f[:, :, 0] = 1.0
    return f


def noise(t: int, sigma: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.linalg.cholesky(sigma) @ rng.standard_normal((len(sigma), t))


def simulate(n: int, k: int, t: int, seed: int = 0, deviations: str = "gaussian", dev_sd: float = 0.1, noise_scale: float = 1.0, b_bar: np.ndarray | None = None, dev_cov: np.ndarray | None = None, sigma: np.ndarray | None = None) -> Simulated:
    """Data whose pooled coefficients, covariance of deviations (dev_sd^2 I) and of residuals may be given."""
    rng = np.random.default_rng(seed)
    f = predictors(n, t, k, rng)
    sigma = random_covariance(n, rng, noise_scale) if sigma is None else np.asarray(sigma, float)
    b_bar = 0.3 * rng.standard_normal(k) if b_bar is None else np.asarray(b_bar, float)
    cov = dev_sd**2 * np.eye(k) if dev_cov is None else np.asarray(dev_cov, float)
    if b_bar.shape != (k,) or cov.shape != (k, k) or sigma.shape != (n, n):
        raise ValueError(f"given parameters don't have the shapes of {n} assets and {k} predictors")
    if deviations == "gaussian":
        theta = gaussian_deviations(n, cov, rng)
    elif deviations == "sparse":
        theta = sparse_deviations(n, cov, rng)
    else:
        raise ValueError(f"deviations are gaussian or sparse, not {deviations!r}")
    b = b_bar + theta
    return Simulated(np.einsum("ntk,nk->nt", f, b) + noise(t, sigma, rng), f, b, b_bar, sigma)


def from_prior(model: str, n: int, k: int, t: int, seed: int, **settings) -> Simulated:
    """Data whose truth is drawn from the model's own prior, which is derived from a first set of returns."""
    rng = np.random.default_rng(seed)
    f = predictors(n, t, k, rng)
    r0 = rng.standard_normal((n, t))
    p = prior_of(model, r0, f, **settings)
    sigma = random_covariance(n, rng)
    b_bar = rng.multivariate_normal(p.mean, p.mean_cov)
    if model == "gaussian":
        theta = gaussian_deviations(n, p.dev_scale / (p.dev_df - k - 1), rng)
    elif model == "lasso":
        theta = rng.laplace(0, p.s / p.rate_rms, (n, k))
    else:
        lam, tau = np.abs(rng.standard_cauchy((n, k))), p.tau_0 * abs(rng.standard_cauchy())
        if model == "regularised":
            c2 = p.slab_scale**2 * p.slab_df / 2 / rng.gamma(p.slab_df / 2)
            lam = np.sqrt(c2 * lam**2 / (c2 + tau**2 * lam**2))
        theta = tau * lam * rng.standard_normal((n, k))
    b = b_bar + theta
    return Simulated(np.einsum("ntk,nk->nt", f, b) + noise(t, sigma, rng), f, b, b_bar, sigma)


def spread(spark: SparkSession, n: int, one: Callable[[int], dict], schema: str) -> DataFrame:
    """A row from each of n tasks."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(int(i)) for i in batch["id"]])

    return spark.range(0, n, 1, n).mapInPandas(go, schema)


def simulated_panels(spark: SparkSession, sets: int, n: int, k: int, t: int, **settings) -> DataFrame:
    """Rows (dataset, asset, t, f, r_next, b) of simulated data sets."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch["id"]:
                s = simulate(n, k, t, seed=int(d), **settings)
                i, at = np.indices((n, t))
                yield pd.DataFrame({"dataset": int(d), "asset": [f"a{x:03d}" for x in i.ravel()], "t": at.ravel().astype(np.int32), "f": [s.f[a, b].tolist() for a, b in zip(i.ravel(), at.ravel())], "r_next": s.r.ravel(), "b": [s.b[a].tolist() for a in i.ravel()]})

    return spark.range(0, sets, 1, sets).mapInPandas(go, "dataset int, asset string, t int, f array<double>, r_next double, b array<double>")


def calibration(spark: SparkSession, model: str, sets: int, n: int, k: int, t: int, draws: int, burn: int, seed: int = 9000, level: float = 0.95, **settings) -> DataFrame:
    """Coverage of credible intervals in data from the prior, by data set, with what tells whether its chain converged."""

    def one(i: int) -> dict:
        from fathomgrid.operators.draws import effective_size

        s = from_prior(model, n, k, t, seed + i, **settings)
        d = run(model, s.r, s.f, prior_of(model, s.r, s.f, **settings), draws, burn, seed + i)
        b, m = d.fields["B"], d.fields["b_bar"]
        q = [(1 - level) / 2, (1 + level) / 2]
        inside = lambda x, truth: float(np.mean((np.quantile(x, q[0], axis=0) <= truth) & (truth <= np.quantile(x, q[1], axis=0))))
        theta = b - m[:, None, :]
        return {"dataset": i, "cover_b": inside(b, s.b), "cover_b_bar": inside(m, s.b_bar), "cover_theta": inside(theta, s.theta), "recovery": float(np.corrcoef(theta.mean(axis=0).ravel(), s.theta.ravel())[0, 1]), "ess": effective_size(m[None, :, 0])}

    return spread(spark, sets, one, "dataset int, cover_b double, cover_b_bar double, cover_theta double, recovery double, ess double")


def calibration_summary(rows: DataFrame, least_ess: float = 50.0) -> DataFrame:
    """Mean coverage over data sets and its standard error; sets whose chain has fewer effective draws are told and left out."""
    used = F.col("ess") >= least_ess
    pick = lambda c: F.when(used, F.col(c))
    return rows.agg(*(f(pick(c)).alias(f"{n}{c}") for c in ("cover_b", "cover_b_bar", "cover_theta", "recovery") for n, f in (("mean_", F.avg), ("sd_", F.stddev_samp))), F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_excluded"))


def prior_predictive(spark: SparkSession, p: priors.Prior, f: np.ndarray, var_r: float, sets: int = 200, seed: int = 0, tails: tuple[float, ...] = (1.0, 10.0)) -> DataFrame:
    """Draws of the horseshoe's prior: tau, effective size, share of variance explained, shares of large deviations."""
    sent = spark.sparkContext.broadcast((p, f))

    def one(i: int) -> dict:
        prior, x = sent.value
        rng = np.random.default_rng([seed, i])
        n, t, k = x.shape
        tau, lam = prior.tau_0 * abs(rng.standard_cauchy()), np.abs(rng.standard_cauchy((n, k)))
        if prior.slab_scale is not None:
            c2 = prior.slab_scale**2 * prior.slab_df / 2 / rng.gamma(prior.slab_df / 2)
            lam = np.sqrt(c2 * lam**2 / (c2 + tau**2 * lam**2))
        theta = tau * lam * rng.standard_normal((n, k))
        fit = np.einsum("ntk,nk->nt", x, theta)
        return {"draw": i, "tau": tau, "m_eff": priors.implied_m_eff(prior, x, tau), "r2": float(fit.var() / (fit.var() + var_r)), **{f"over_{j}": float((np.abs(theta) > c).mean()) for j, c in enumerate(tails)}}

    return spread(spark, sets, one, "draw int, tau double, m_eff double, r2 double" + "".join(f", over_{j} double" for j in range(len(tails))))


def sparsity_recovery(spark: SparkSession, model: str, sets: int, n: int, k: int, t: int, draws: int, burn: int, seed: int = 0, **settings) -> DataFrame:
    """Errors of the posterior means on sparse data and on a dense control of equal size, and how many true actives lead."""

    def one(i: int) -> dict:
        out = {"dataset": i}
        for kind in ("sparse", "gaussian"):
            s = simulate(n, k, t, seed + i, kind, dev_sd=0.5 if kind == "sparse" else 0.5 * 0.3**0.5)
            theta = run(model, s.r, s.f, prior_of(model, s.r, s.f, **settings), draws, burn, seed + i).fields
            mean = (theta["B"] - theta["b_bar"][:, None, :]).mean(axis=0)
            name = "sparse" if kind == "sparse" else "dense"
            out[f"rmse_{name}"] = float(np.sqrt(((mean - s.theta) ** 2).mean()))
            if kind == "sparse":
                active = np.flatnonzero(s.theta.ravel())
                lead = np.argsort(-np.abs(mean.ravel()))[: len(active)]
                out["found"] = len(np.intersect1d(active, lead)) / max(1, len(active))
        return out

    return spread(spark, sets, one, "dataset int, rmse_sparse double, found double, rmse_dense double")
