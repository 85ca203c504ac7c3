"""The two horseshoe models as densities of unconstrained coordinates with gradients, sampled by NUTS."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import sur
from .priors import Prior, least_squares
from .samplers import Draws

#: Energy error beyond which a trajectory counts as divergent.
DIVERGENT = 1_000.0
Density = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Target:
    """Log density and gradient of a horseshoe model, not centred: b = b_bar + z lambda tau, every coordinate O(1).

    Coordinates are, in order: b_bar in units of its prior's Cholesky factor (K), z (N K), log lambda (N K),
    log(tau / tau_0), the packed Cholesky factor of Sigma from that of the residuals in units of its scales, and for the
    regularised model log(c^2 / slab_scale^2).
    """

    def __init__(self, model: str, r: np.ndarray, f: np.ndarray, prior: Prior):
        if model not in ("horseshoe", "regularised"):
            raise ValueError(f"NUTS samples the horseshoe and the regularised model, not {model!r}")
        if prior.tau_0 is None or model == "regularised" and prior.slab_scale is None:
            raise ValueError(f"the prior isn't that of the {model} model")
        self.slab, self.r, self.f, self.prior = model == "regularised", r, f, prior
        self.n, self.t, self.k = f.shape
        low, self.scale = sur.sigma_reference(r, f)
        self.origin = sur.packed(low)
        self.half = np.linalg.cholesky(prior.mean_cov)
        nk = self.n * self.k
        self.cuts = np.cumsum([self.k, nk, nk, 1, len(self.origin)])
        self.size = int(self.cuts[-1]) + self.slab

    def start(self) -> np.ndarray:
        """Least squares averaged over assets, no deviations, unit scales, the residuals' covariance."""
        x = np.zeros(self.size)
        x[: self.k] = np.linalg.solve(self.half, least_squares(self.r, self.f).mean(axis=0) - self.prior.mean)
        return x

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        u, z, lam, tau, sigma = np.split(x[: self.cuts[-1]], self.cuts[:-1])
        shape = (self.n, self.k)
        return u, z.reshape(shape), lam.reshape(shape), tau[0], self.origin + self.scale * sigma, x[-1] if self.slab else None

    def scales(self, lam: np.ndarray, tau: float, slab: float | None) -> tuple[np.ndarray, np.ndarray]:
        """lambda tau with the slab's ceiling, and the share w = c^2 / (c^2 + tau^2 lambda^2) (1 without a slab)."""
        log_scale = lam + tau + math.log(self.prior.tau_0)
        if slab is None:
            return np.exp(log_scale), np.ones_like(lam)
        c2 = slab + 2 * math.log(self.prior.slab_scale)
        log_w = c2 - np.logaddexp(c2, 2 * log_scale)
        return np.exp(log_scale + 0.5 * log_w), np.exp(log_w)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        with np.errstate(all="ignore"):
            try:
                value, grad = self._density(x)
            except np.linalg.LinAlgError:
                value, grad = -math.inf, np.zeros(self.size)
        return (value, grad) if math.isfinite(value) and np.isfinite(grad).all() else (-math.inf, np.zeros(self.size))

    def _density(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        u, z, lam, tau, packed, slab = self.parts(x)
        scale, w = self.scales(lam, tau, slab)
        b = self.prior.mean + self.half @ u + z * scale
        low = sur.unpacked(packed, self.n)
        white = np.linalg.solve(low, sur.residuals(self.r, self.f, b))
        back = np.linalg.solve(low.T, white)
        value = -0.5 * (self.n * self.t * math.log(2 * math.pi) + float((white * white).sum())) - self.t * float(np.log(np.diag(low)).sum())
        in_b = np.einsum("ntk,nt->nk", self.f, back)
        in_sigma = 0.5 * (back @ back.T - self.t * sur.spd_inverse(low @ low.T))
        value += sur.packed_inverse_wishart_logpdf(packed, self.prior.sigma_df, self.prior.sigma_scale)
        in_packed = sur.packed_gradient(low, in_sigma) + sur.packed_inverse_wishart_gradient(packed, self.prior.sigma_df, self.prior.sigma_scale)
        # standard normals, and half-Cauchy scales by their logarithms
        value -= 0.5 * float(u @ u + (z * z).sum()) + 0.5 * (self.k + z.size) * math.log(2 * math.pi)
        value += float((math.log(2 / math.pi) + lam - np.logaddexp(0, 2 * lam)).sum()) + math.log(2 / math.pi) + tau - float(np.logaddexp(0, 2 * tau))
        moved = in_b * z * scale  # by a relative change of the scale
        grad = [
            self.half.T @ in_b.sum(axis=0) - u,
            (in_b * scale - z).ravel(),
            (moved * w + 1 - 2 / (1 + np.exp(-2 * lam))).ravel(),
            [float((moved * w).sum()) + 1 - 2 / (1 + math.exp(-2 * tau))],
            in_packed * self.scale,
        ]
        if self.slab:
            a = self.prior.slab_df / 2  # c^2 / slab_scale^2 is inverse Gamma(a, a)
            value += a * math.log(a) - math.lgamma(a) - a * slab - a * math.exp(-slab)
            grad.append([0.5 * float((moved * (1 - w)).sum()) - a + a * math.exp(-slab)])
        return value, np.concatenate(grad)

    def fields(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters at a point, under the names of the other sampler."""
        u, z, lam, tau, packed, slab = self.parts(x)
        scale, w = self.scales(lam, tau, slab)
        low, b_bar = sur.unpacked(packed, self.n), self.prior.mean + self.half @ u
        out = {"B": b_bar + z * scale, "b_bar": b_bar, "Sigma": low @ low.T, "lam_local": np.exp(lam), "tau": np.float64(self.prior.tau_0 * math.exp(tau))}
        if self.slab:
            out |= {"lam_tilde": np.exp(lam) * np.sqrt(w), "c": np.float64(self.prior.slab_scale * math.exp(slab / 2))}
        return out


class Trajectory:
    """One NUTS transition (multinomial weights, doubling until a U-turn) from a point with a given step and metric."""

    def __init__(self, density: Density, metric: np.ndarray, step: float, rng: np.random.Generator):
        self.density, self.metric, self.step, self.rng = density, metric, step, rng
        self.leaps, self.accepted, self.divergent, self.energy = 0, 0.0, False, 0.0

    def leap(self, point: tuple, sign: int) -> tuple:
        """A leapfrog step of a point (position, momentum, log density, gradient)."""
        x, p, _, g = point
        p = p + 0.5 * sign * self.step * g
        x = x + sign * self.step * self.metric * p
        value, g = self.density(x)
        return x, p + 0.5 * sign * self.step * g, value, g

    def total(self, point: tuple) -> float:
        return -point[2] + 0.5 * float(point[1] @ (self.metric * point[1]))

    def turned(self, momentum: np.ndarray, left: tuple, right: tuple) -> bool:
        along = self.metric * momentum
        return along @ left[1] <= 0 or along @ right[1] <= 0

    def grow(self, point: tuple, sign: int, depth: int) -> tuple | None:
        """A subtree of 2^depth steps from a point: (near end, far end, chosen, log weight, momenta); None if it ends."""
        if depth == 0:
            new = self.leap(point, sign)
            error = self.total(new) - self.energy
            self.leaps += 1
            self.accepted += min(1.0, math.exp(min(0.0, -error))) if math.isfinite(error) else 0.0
            if not error < DIVERGENT:
                self.divergent = True
                return None
            return new, new, new, -error, new[1]
        first = self.grow(point, sign, depth - 1)
        second = first and self.grow(first[1], sign, depth - 1)
        if not second:
            return None
        weight, momentum = np.logaddexp(first[3], second[3]), first[4] + second[4]
        if self.turned(momentum, first[0], second[1]) if sign > 0 else self.turned(momentum, second[1], first[0]):
            return None
        chosen = second[2] if math.log(self.rng.random()) < second[3] - weight else first[2]
        return first[0], second[1], chosen, weight, momentum

    def run(self, x: np.ndarray, value: float, grad: np.ndarray, most: int) -> tuple[tuple, int]:
        """The next point, and the depth reached (at most most)."""
        start = (x, self.rng.standard_normal(len(x)) / np.sqrt(self.metric), value, grad)
        self.energy = self.total(start)
        left = right = chosen = start
        weight, momentum, depth = 0.0, start[1], 0
        while depth < most:
            sign = 1 if self.rng.random() < 0.5 else -1
            tree = self.grow(right if sign > 0 else left, sign, depth)
            depth += 1
            if tree is None:
                break
            left, right = (left, tree[1]) if sign > 0 else (tree[1], right)
            if math.log(self.rng.random()) < tree[3] - weight:
                chosen = tree[2]
            weight, momentum = np.logaddexp(weight, tree[3]), momentum + tree[4]
            if self.turned(momentum, left, right):
                break
        return chosen, depth


class Step:
    """Dual averaging of the step's logarithm towards a mean acceptance (Hoffman and Gelman, 2014)."""

    # Of the published algorithm.
    GAMMA, OFFSET, DECAY = 0.05, 10, 0.75

    def __init__(self, first: float, accept: float):
        self.centre, self.accept, self.now = math.log(10 * first), accept, math.log(first)
        self.error = self.mean = 0.0
        self.n = 0

    def update(self, accepted: float) -> None:
        self.n += 1
        self.error += (self.accept - accepted - self.error) / (self.n + self.OFFSET)
        self.now = self.centre - math.sqrt(self.n) / self.GAMMA * self.error
        share = self.n**-self.DECAY
        self.mean = share * self.now + (1 - share) * self.mean


def first_step(density: Density, x: np.ndarray, value: float, grad: np.ndarray, metric: np.ndarray, rng: np.random.Generator) -> float:
    """A step whose single leap is accepted about half of the time."""
    step, way = 0.1, 0
    p = rng.standard_normal(len(x)) / np.sqrt(metric)
    for _ in range(60):
        t = Trajectory(density, metric, step, rng)
        start = (x, p, value, grad)
        change = t.total(start) - t.total(t.leap(start, 1))
        up = 1 if math.isfinite(change) and change > math.log(0.5) else -1
        if way and up != way:
            break
        way = up
        step *= 2.0**up
    return step


def sample(density: Density, x: np.ndarray, draws: int, tune: int, rng: np.random.Generator, accept: float = 0.9, most: int = 10) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """draws points after tune steps of tuning, and statistics of each: energy, tree_depth, n_steps, diverging, step_size.

    The step is tuned throughout; the diagonal metric is set to the variances met since the last change at a quarter, a
    half and nine tenths of the tuning.
    """
    metric = np.ones(len(x))
    value, grad = density(x)
    if not math.isfinite(value):
        raise ValueError("the starting point has no density")
    step = Step(first_step(density, x, value, grad, metric, rng), accept)
    changes = {int(tune * share) for share in (0.25, 0.5, 0.9)}
    seen: list[np.ndarray] = []
    kept, stats = np.empty((draws, len(x))), {k: [] for k in ("energy", "tree_depth", "n_steps", "diverging", "step_size")}
    for i in range(tune + draws):
        size = math.exp(step.now if i < tune else step.mean)
        t = Trajectory(density, metric, size, rng)
        (x, p, value, grad), depth = t.run(x, value, grad, most)
        if i < tune:
            step.update(t.accepted / max(1, t.leaps))
            seen.append(x)
            if i + 1 in changes and len(seen) > 10:
                n = len(seen)
                metric = n / (n + 5) * np.var(seen, axis=0, ddof=1) + 5 / (n + 5) * 1e-3
                seen = []
                step = Step(first_step(density, x, value, grad, metric, rng), accept)
            continue
        kept[i - tune] = x
        for name, v in zip(stats, (-value + 0.5 * float(p @ (metric * p)), depth, t.leaps, t.divergent, size)):
            stats[name].append(v)
    return kept, {k: np.array(v, float) for k, v in stats.items()}


def run(model: str, r: np.ndarray, f: np.ndarray, prior: Prior, draws: int = 1_500, tune: int = 1_000, seed: int = 0, accept: float = 0.9, most: int = 10) -> Draws:
    """A chain of draws after tune steps (which don't count among them), with the sampler's statistics as fields."""
    if draws < 1 or tune < 0:
        raise ValueError(f"{draws} draws after {tune} steps of tuning can't be run")
    target = Target(model, r, f, prior)
    points, stats = sample(target, target.start(), draws, tune, np.random.default_rng(seed), accept, most)
    rows = [target.fields(x) for x in points]
    fields = {k: np.stack([row[k] for row in rows]) for k in rows[0]}
    return Draws(fields | stats, {}, {"model": model, "sampler": "nuts", "draws": draws, "tune": tune, "seed": seed, "accept": accept, "max_treedepth": most})
