"""Prior scales derived from the training data alone, shared by the four models."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Prior:
    """What a model's sampler holds fixed. Fields that a model doesn't use stay None."""

    mean: np.ndarray  # of b_bar
    mean_cov: np.ndarray  # of b_bar
    sigma_df: float
    sigma_scale: np.ndarray
    dev_df: float | None = None  # inverse Wishart of the deviations' covariance
    dev_scale: np.ndarray | None = None
    sd_target: float | None = None  # deviation sd that the Gaussian model's prior implies
    s: float | None = None  # pooled residual sd
    rate_shape: float | None = None  # Gamma prior of the LASSO's squared rate
    rate_rate: float | None = None
    tau_0: float | None = None
    p0: int | None = None
    slab_scale: float | None = None
    slab_df: float | None = None

    @property
    def rate_rms(self) -> float:
        return math.sqrt(self.rate_shape / self.rate_rate)

    @property
    def tau_over_target(self) -> float:
        return self.tau_0 / self.sd_target

    @property
    def slab_variance(self) -> float:
        """Of the Student slab with slab_df degrees."""
        return self.slab_scale**2 / (1 - 2 / self.slab_df)

    def __post_init__(self) -> None:
        if self.p0 is not None and not 0 < self.p0 < len(self.mean):
            raise ValueError(f"p0 {self.p0} isn't between 0 and {len(self.mean)}")
        if self.slab_df is not None and not self.slab_df > 2:
            raise ValueError(f"a slab with {self.slab_df} degrees has no variance")


def slab_reach(slab_variance: float, tau: float) -> tuple[float, float]:
    """The local scale from which on the slab is narrower than tau times it, and how likely a half-Cauchy scale exceeds it."""
    limit = math.sqrt(slab_variance) / tau
    return limit, 1 - math.atan(limit) * 2 / math.pi


def sample_covariance(r: np.ndarray) -> np.ndarray:
    """Covariance of assets over months (one degree of freedom less); must be positive definite."""
    s = np.atleast_2d(np.cov(r))
    try:
        np.linalg.cholesky(s)
    except np.linalg.LinAlgError as e:
        raise ValueError(f"the covariance of {len(r)} assets over {r.shape[1]} months isn't positive definite") from e
    return s


def predictor_trace(f: np.ndarray) -> float:
    """Trace of the predictors' covariance, pooled over assets and months."""
    return float(f.reshape(-1, f.shape[2]).var(axis=0, ddof=1).sum())


def pooled_scale(r: np.ndarray, f: np.ndarray) -> tuple[float, np.ndarray]:
    """Residual sd of least squares by asset, with N (T - K) degrees of freedom, and the coefficients."""
    n, t, k = f.shape
    if t <= k:
        raise ValueError(f"{t} months can't give {k} coefficients a residual variance")
    b = least_squares(r, f)
    e = r - np.einsum("ntk,nk->nt", f, b)
    return math.sqrt(float((e * e).sum()) / (n * (t - k))), b


def least_squares(r: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(f, r)])


def default_prior(r: np.ndarray, k: int) -> Prior:
    n = len(r)
    return Prior(mean=np.zeros(k), mean_cov=0.1 * np.eye(k), sigma_df=n + 2.0, sigma_scale=sample_covariance(r), dev_df=1001.0 + k, dev_scale=3.0 * np.eye(k))


def coefficient_variance(p: Prior) -> float:
    """Prior variance of a coefficient in the Gaussian model: of the mean, and the expected one of a deviation."""
    k = len(p.mean)
    return float(p.mean_cov[0, 0] + p.dev_scale[0, 0] / (p.dev_df - k - 1))


def rescaled_prior(r: np.ndarray, f: np.ndarray, target_r2: float = 0.05) -> Prior:
    """The default prior with both scales multiplied so that the prior explains target_r2 of the returns' variance."""
    base = default_prior(r, f.shape[2])
    c = target_r2 * float(r.var()) / (predictor_trace(f) * coefficient_variance(base))
    k = f.shape[2]
    return replace(base, mean_cov=c * base.mean_cov, dev_scale=c * base.dev_scale, sd_target=math.sqrt(c * base.dev_scale[0, 0] / (base.dev_df - k - 1)))


def implied_r2(p: Prior, r: np.ndarray, f: np.ndarray) -> float:
    """Share of the returns' variance that a prior expects predictors to explain (Gaussian, or LASSO if it has a rate)."""
    v = coefficient_variance(p) if p.rate_shape is None else float(p.mean_cov[0, 0]) + 2 * p.s**2 * p.rate_rate / p.rate_shape
    return v * predictor_trace(f) / float(r.var())


def lasso_prior(r: np.ndarray, f: np.ndarray, target_r2: float = 0.05, shape: float = 1.0, multiplier: float = 1.0) -> Prior:
    """The rate is centred where a Laplace deviation has the Gaussian prior's sd; the squared rate is Gamma."""
    base = rescaled_prior(r, f, target_r2)
    s, _ = pooled_scale(r, f)
    rate = math.sqrt(2) * s / base.sd_target
    return replace(base, s=s, rate_shape=shape, rate_rate=shape / (multiplier * rate) ** 2)


def signal_variance(r: np.ndarray, f: np.ndarray, target_r2: float, active: int) -> float:
    """Variance of each of so many coefficients that together explain target_r2 of the returns' variance."""
    each = predictor_trace(f) / f.shape[2]
    return target_r2 * float(r.var()) / (active * each)


def sparse_prior(r: np.ndarray, f: np.ndarray, p0: int = 23, target_r2: float = 0.05, n_choice: str = "T", nu: float | None = None, slab_scale: float | None = None) -> Prior:
    """A global scale under which p0 deviations an asset are expected to be active (Piironen and Vehtari, 2017).

    The sample has T observations, or N T. With nu there is a slab of so many degrees, whose variance is that of p0
    coefficients which explain target_r2, unless its scale is given.
    """
    n, t, k = f.shape
    sizes = {"T": t, "NT": n * t}
    if n_choice not in sizes:
        raise ValueError(f"n_choice is one of {', '.join(sizes)}, not {n_choice!r}")
    noise, _ = pooled_scale(r, f)
    found = replace(rescaled_prior(r, f, target_r2), s=noise, p0=p0, slab_df=nu)
    odds = p0 / (k - p0)
    if nu is not None and slab_scale is None:
        slab_scale = math.sqrt(signal_variance(r, f, target_r2, p0) * (1 - 2 / nu))
    return replace(found, tau_0=odds * noise / math.sqrt(sizes[n_choice]), slab_scale=slab_scale)


def implied_m_eff(p: Prior, f: np.ndarray, tau: float | None = None, unit: bool = False) -> float:
    """Expected number of nonzero deviations an asset under tau; the sample size is always T."""
    n, t, k = f.shape
    s = np.ones((n, k)) if unit else np.sqrt((f * f).mean(axis=1))
    a = (p.tau_0 if tau is None else tau) / p.s * math.sqrt(t) * s
    return float((a / (1 + a)).sum(axis=1).mean())
