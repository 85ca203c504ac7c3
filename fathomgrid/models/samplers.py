"""Gibbs samplers of the four models. The blocked draw of all coefficients is shared; only deviations' scales differ."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .priors import Prior, least_squares, sample_covariance
from .sur import cross_products, inverse_wishart, precision_draw, residuals, spd_inverse


@dataclass
class Draws:
    """Kept draws by field (leading axis: draw), running means, and what is known about the run."""

    fields: dict[str, np.ndarray]
    means: dict[str, np.ndarray] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


@dataclass
class State:
    b: np.ndarray
    b_bar: np.ndarray
    sigma: np.ndarray
    extra: dict = field(default_factory=dict)

    @property
    def theta(self) -> np.ndarray:
        return self.b - self.b_bar


class Data:
    """Arrays and the cross products that every sweep uses."""

    def __init__(self, r: np.ndarray, f: np.ndarray, prior: Prior):
        if r.ndim != 2 or f.ndim != 3 or f.shape[:2] != r.shape or f.shape[2] != len(prior.mean):
            raise ValueError(f"R {r.shape}, F {f.shape} and a prior of {len(prior.mean)} predictors don't match")
        self.r, self.f, self.prior = r, f, prior
        self.n, self.t, self.k = f.shape
        self.gram, self.fr = cross_products(f, r)
        self.mean_precision = spd_inverse(prior.mean_cov)


def start(data: Data, b: np.ndarray | None = None) -> State:
    """Least squares, their mean over assets, the returns' covariance."""
    b = least_squares(data.r, data.f) if b is None else b.copy()
    return State(b, b.mean(axis=0), sample_covariance(data.r))


def draw_coefficients(data: Data, state: State, precisions: np.ndarray, rng: np.random.Generator, diagonal: bool = False) -> None:
    """(B, b_bar) in one block, deviations having precision D_i^-1: one (K, K) matrix, or diagonals (N, K)."""
    n, k = data.n, data.k
    inverse = spd_inverse(state.sigma)
    rhs = np.einsum("ij,ikj->ik", inverse, data.fr).ravel()
    p = np.zeros(((n + 1) * k, (n + 1) * k))
    blocks = p.reshape(n + 1, k, n + 1, k)  # the same numbers; the lower triangle is enough
    total = data.mean_precision.copy()
    for i in range(n):
        d = np.diag(precisions[i]) if diagonal else precisions
        np.multiply(inverse[i, None, : i + 1, None], data.gram[i, :, : i + 1], out=blocks[i, :, : i + 1])
        blocks[i, :, i] += d
        blocks[n, :, i] = -d
        total += d
    blocks[n, :, n] = total
    x = precision_draw(p, np.concatenate([rhs, data.mean_precision @ data.prior.mean]), rng)
    state.b, state.b_bar = x[: n * k].reshape(n, k), x[n * k :]


def draw_b(data: Data, state: State, precision: np.ndarray, rng: np.random.Generator) -> None:
    """Coefficients asset by asset, each given those of the others and the mean (the sequential scan's first half)."""
    inverse = spd_inverse(state.sigma)
    prior = precision @ state.b_bar
    for i in range(data.n):
        own = inverse[i, i] * data.gram[i, :, i]
        others = np.tensordot(data.gram[i], inverse[i][:, None] * state.b, axes=([1, 2], [0, 1])) - own @ state.b[i]
        state.b[i] = precision_draw(own + precision, data.fr[i] @ inverse[i] - others + prior, rng)


def draw_b_bar(data: Data, state: State, precision: np.ndarray, rng: np.random.Generator) -> None:
    state.b_bar = precision_draw(data.n * precision + data.mean_precision, precision @ state.b.sum(axis=0) + data.mean_precision @ data.prior.mean, rng)


def draw_deviation_covariance(data: Data, state: State, rng: np.random.Generator) -> np.ndarray:
    return inverse_wishart(data.prior.dev_df + data.n, data.prior.dev_scale + state.theta.T @ state.theta, rng)


def draw_sigma(data: Data, state: State, rng: np.random.Generator) -> None:
    e = residuals(data.r, data.f, state.b)
    state.sigma = inverse_wishart(data.prior.sigma_df + data.t, data.prior.sigma_scale + e @ e.T, rng)


def draw_local_variance(theta: np.ndarray, s: float, rate: float, rng: np.random.Generator) -> np.ndarray:
    """tau^2 of the LASSO: 1/tau^2 is inverse Gaussian(rate s / |theta|, rate^2), in a form without cancellation."""
    a = np.maximum(np.abs(theta), 1e-300)
    y = np.maximum(rng.standard_normal(theta.shape) ** 2, 1e-300)
    x = 4 * rate * rate / y / (1 + np.sqrt(1 + 4 * rate * a / (s * y))) ** 2
    ratio = x * a / (rate * s)
    keep = rng.random(theta.shape) < 1 / (1 + ratio)
    return 1 / np.where(keep, x, x / np.maximum(ratio, 1e-150) ** 2)


def draw_rate(theta: np.ndarray, s: float, shape: float, rate: float, rng: np.random.Generator, tries: int = 10_000) -> float:
    """The LASSO's rate with tau^2 integrated out: a Gamma proposal at the mode, then exact rejection."""
    a = theta.size + 2 * shape - 1
    c = float(np.abs(theta).sum()) / s
    if rate <= 0:
        return float(rng.gamma(a) / c)
    mode = (-c + math.sqrt(c * c + 8 * rate * (a - 1))) / (4 * rate)
    for _ in range(tries):
        x = float(rng.gamma(a) / (c + 2 * rate * mode))
        if rng.random() < math.exp(-rate * (x - mode) ** 2):
            return x
    raise RuntimeError("the rate's rejection sampler found nothing")


def draw_rate_given_variance(tau2: np.ndarray, shape: float, rate: float, rng: np.random.Generator) -> float:
    """The rate given tau^2 (the textbook step, which mixes slowly)."""
    return math.sqrt(rng.gamma(shape + tau2.size) / (rate + tau2.sum() / 2))


def _inverse_gamma(shape: float | np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return scale / np.maximum(rng.gamma(shape, size=np.shape(scale)), 1e-300)


#: Steps of a slice update, of which tens are usual; a variance below which a deviation is zero to double precision.
STEPS, LEAST_VARIANCE = 2_000, 1e-18


def slice_step(log_density: Callable[[np.ndarray], np.ndarray], x: np.ndarray, rng: np.random.Generator, width: float = 1.0) -> np.ndarray:
    """One slice update of each element on its own (stepping out, then shrinking); log_density works by element.

    Both go on until they are done; one that takes STEPS steps fails, as ending it early would change the target.
    """
    level = log_density(x) + np.log(np.maximum(rng.random(x.shape), 1e-300))
    lo = x - width * rng.random(x.shape)
    hi = lo + width
    for edge, sign in ((lo, -1), (hi, 1)):
        for _ in range(STEPS):
            out = log_density(edge) > level
            if not out.any():
                break
            edge[out] += sign * width
        else:
            raise RuntimeError("a slice has no end")
    new, todo = x.copy(), np.ones(x.shape, bool)
    for _ in range(STEPS):
        trial = lo + (hi - lo) * rng.random(x.shape)
        ok = todo & (log_density(trial) >= level)
        new[ok] = trial[ok]
        todo &= ~ok
        if not todo.any():
            break
        left = todo & (trial < x)
        lo[left], hi[todo & ~left] = trial[left], trial[todo & ~left]
    else:
        raise RuntimeError("no point of a slice was found")
    return new


def _gaussian(data: Data, state: State, rng: np.random.Generator, blocked: bool) -> dict:
    x = state.extra
    if "delta" not in x:
        k = data.k
        x["delta"] = data.prior.dev_scale / (data.prior.dev_df - k - 1)
    precision = spd_inverse(x["delta"])
    if blocked:
        draw_coefficients(data, state, precision, rng)
    else:
        draw_b(data, state, precision, rng)
        draw_b_bar(data, state, precision, rng)
    x["delta"] = draw_deviation_covariance(data, state, rng)
    draw_sigma(data, state, rng)
    d = x["delta"]
    return {"Delta_b_diag": np.diag(d).copy(), "Delta_b_off": d[0, 1:].copy()}


def _lasso(data: Data, state: State, rng: np.random.Generator, blocked: bool) -> dict:
    x, p = state.extra, data.prior
    if "tau2" not in x:
        x["rate"] = p.rate_rms
        x["tau2"] = np.full((data.n, data.k), 2 / x["rate"] ** 2)
    draw_coefficients(data, state, 1 / (p.s**2 * x["tau2"]), rng, True)
    x["rate"] = draw_rate(state.theta, p.s, p.rate_shape, p.rate_rate, rng)
    x["tau2"] = draw_local_variance(state.theta, p.s, x["rate"], rng)
    draw_sigma(data, state, rng)
    return {"lam": np.float64(x["rate"]), "tau2": x["tau2"]}


def _horseshoe(data: Data, state: State, rng: np.random.Generator, blocked: bool) -> dict:
    """Half-Cauchy scales by inverse-gamma auxiliaries (Makalic and Schmidt, 2016)."""
    x, p = state.extra, data.prior
    shape = (data.n, data.k)
    if "lam2" not in x:
        x |= {"lam2": np.ones(shape), "nu": np.ones(shape), "tau2": p.tau_0**2, "xi": 1.0}
    draw_coefficients(data, state, 1 / np.maximum(x["tau2"] * x["lam2"], LEAST_VARIANCE), rng, True)
    square = state.theta**2
    # a half-Cauchy scale passes these bounds with a probability below 1e-70
    x["lam2"] = np.clip(_inverse_gamma(1.0, 1 / x["nu"] + square / (2 * x["tau2"]), rng), 1e-150, 1e150)
    x["nu"] = _inverse_gamma(1.0, 1 + 1 / x["lam2"], rng)
    x["tau2"] = float(_inverse_gamma((data.n * data.k + 1) / 2, np.array(1 / x["xi"] + (square / (2 * x["lam2"])).sum()), rng))
    x["xi"] = float(_inverse_gamma(1.0, np.array(1 / p.tau_0**2 + 1 / x["tau2"]), rng))
    draw_sigma(data, state, rng)
    return {"lam_local": np.sqrt(x["lam2"]), "tau": np.float64(math.sqrt(x["tau2"]))}


def _regularised(data: Data, state: State, rng: np.random.Generator, blocked: bool) -> dict:
    """Scales with a slab aren't conjugate: slice updates of their logarithms."""
    x, p = state.extra, data.prior
    if "lam" not in x:
        x |= {"lam": np.zeros((data.n, data.k)), "tau": math.log(p.tau_0), "c2": math.log(p.slab_variance)}

    def variance(lam, tau, c2):
        a = 2 * (lam + tau)
        return np.exp(a + c2 - np.logaddexp(c2, a))  # c^2 tau^2 lam^2 / (c^2 + tau^2 lam^2)

    def normal(v):
        return -0.5 * (np.log(v) + square / v)

    draw_coefficients(data, state, 1 / np.maximum(variance(x["lam"], x["tau"], x["c2"]), LEAST_VARIANCE), rng, True)
    square = state.theta**2
    x["lam"] = slice_step(lambda z: normal(variance(z, x["tau"], x["c2"])) + z - np.log1p(np.exp(np.minimum(2 * z, 700))), x["lam"], rng)
    one = lambda g: lambda z: np.array([g(float(v)) for v in np.atleast_1d(z)])
    x["tau"] = float(slice_step(one(lambda z: normal(variance(x["lam"], z, x["c2"])).sum() + z - math.log1p(math.exp(min(700.0, 2 * (z - math.log(p.tau_0)))))), np.array([x["tau"]]), rng)[0])
    half = p.slab_df / 2
    x["c2"] = float(slice_step(one(lambda z: normal(variance(x["lam"], x["tau"], z)).sum() - half * z - half * p.slab_scale**2 * math.exp(min(700.0, -z))), np.array([x["c2"]]), rng)[0])
    draw_sigma(data, state, rng)
    lam, tau, c2 = np.exp(x["lam"]), math.exp(x["tau"]), math.exp(x["c2"])
    return {"lam_local": lam, "lam_tilde": np.sqrt(c2 * lam * lam / (c2 + tau * tau * lam * lam)), "tau": np.float64(tau), "c": np.float64(math.sqrt(c2))}


SWEEPS = {"gaussian": _gaussian, "lasso": _lasso, "horseshoe": _horseshoe, "regularised": _regularised}
#: Fields of which only running means are kept, and of the inverse too where so named.
MEANS = {"lasso": {"tau2": True}}


def run(model: str, r: np.ndarray, f: np.ndarray, prior: Prior, draws: int = 3000, burn: int = 1000, seed: int = 0, blocked: bool = True, b0: np.ndarray | None = None, track: int = 5) -> Draws:
    """A chain of a model; draws includes the burn-in. tau2 of the LASSO is kept as means and track traced elements."""
    if model not in SWEEPS:
        raise ValueError(f"{model!r} isn't one of {', '.join(SWEEPS)}")
    if not 0 <= burn < draws:
        raise ValueError(f"burn-in {burn} must be less than draws {draws}")
    data = Data(r, f, prior)
    rng = np.random.default_rng(seed)
    state, sweep = start(data, b0), SWEEPS[model]
    traced = np.random.default_rng(0).choice(data.n * data.k, min(track, data.n * data.k), replace=False)
    kept: dict[str, list] = {}
    sums: dict[str, np.ndarray] = {}
    for i in range(draws):
        extra = sweep(data, state, rng, blocked)
        if i < burn:
            continue
        for name, inverse in MEANS.get(model, {}).items():
            x = extra.pop(name)
            sums[f"{name}_mean"] = sums.get(f"{name}_mean", 0) + x
            if inverse:
                sums[f"{name}_inv_mean"] = sums.get(f"{name}_inv_mean", 0) + 1 / x
            extra[f"{name}_track"] = x.ravel()[traced]
        for name, x in {"B": state.b, "b_bar": state.b_bar, "Sigma": state.sigma, **extra}.items():
            kept.setdefault(name, []).append(np.array(x))
    count = draws - burn
    return Draws({k: np.stack(v) for k, v in kept.items()}, {k: v / count for k, v in sums.items()}, {"model": model, "draws": draws, "burn": burn, "seed": seed, "blocked": blocked})


def binding_summary(d: Draws, tolerance: float = 0.99) -> dict[str, float]:
    """How often the slab binds in a chain of the regularised horseshoe."""
    ratio = d.fields["lam_tilde"] / d.fields["lam_local"]
    return {"binding": float((ratio < tolerance).mean()), "halved": float((ratio < 0.5).mean()), "mean_ratio": float(ratio.mean())}
