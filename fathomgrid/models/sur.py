"""Seemingly unrelated regressions: likelihood, inverse-Wishart densities and draws, Gaussian precision draws."""

from __future__ import annotations

import math

import numpy as np


def predict(f: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ntk,nk->nt", f, b)


def residuals(r: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    return r - predict(f, b)


def spd_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix; fails where it isn't one."""
    half = np.linalg.inv(np.linalg.cholesky(a))
    return half.T @ half


def log_likelihood(r: np.ndarray, f: np.ndarray, b: np.ndarray, sigma: np.ndarray) -> float:
    """Of residuals that are independent over months with covariance sigma over assets."""
    return log_likelihood_gradient(r, f, b, sigma)[0]


def log_likelihood_gradient(r: np.ndarray, f: np.ndarray, b: np.ndarray, sigma: np.ndarray) -> tuple[float, np.ndarray]:
    """The log-likelihood and its gradient in b."""
    n, t = r.shape
    low = np.linalg.cholesky(sigma)
    e = residuals(r, f, b)
    white = np.linalg.solve(low, e)
    value = -0.5 * (n * t * math.log(2 * math.pi) + float((white * white).sum())) - t * float(np.log(np.diag(low)).sum())
    return value, np.einsum("ntk,nt->nk", f, np.linalg.solve(low.T, white))


def log_likelihood_sigma_gradient(r: np.ndarray, f: np.ndarray, b: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The log-likelihood's gradient in the entries of sigma, taken as free: (Sigma^-1 E E' Sigma^-1 - T Sigma^-1) / 2."""
    inverse = spd_inverse(sigma)
    white = inverse @ residuals(r, f, b)
    return 0.5 * (white @ white.T - r.shape[1] * inverse)


def cross_products(f: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """f_i'f_j as (N, K, N, K) and f_i'r_j as (N, K, N): what every sweep needs of the data."""
    n, t, k = f.shape
    wide = f.transpose(0, 2, 1).reshape(n * k, t)
    return (wide @ wide.T).reshape(n, k, n, k), (wide @ r.T).reshape(n, k, n)


def precision_draw(precision: np.ndarray, rhs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw from N(P^-1 rhs, P^-1); only the lower triangle of P is read."""
    low = np.linalg.cholesky(precision)
    return solve_transposed(low, solve_lower(low, rhs) + rng.standard_normal(len(rhs)))


#: Rows of a triangle that are solved at a time; what stands beside them is a product.
BLOCK = 64


def solve_lower(low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """L^-1 x of a lower triangle, without factoring it again."""
    out = np.array(x, float)
    for a in range(0, len(low), BLOCK):
        b = a + BLOCK
        out[a:b] = np.linalg.solve(low[a:b, a:b], out[a:b] - low[a:b, :a] @ out[:a])
    return out


def solve_transposed(low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """L'^-1 x."""
    out = np.array(x, float)
    for a in reversed(range(0, len(low), BLOCK)):
        b = a + BLOCK
        out[a:b] = np.linalg.solve(low[a:b, a:b].T, out[a:b] - low[b:, a:b].T @ out[b:])
    return out


def inverse_wishart(df: float, scale: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw with mean scale / (df - p - 1), by Bartlett's decomposition."""
    p = len(scale)
    a = np.tril(rng.standard_normal((p, p)), -1)
    a[np.arange(p), np.arange(p)] = np.sqrt(rng.chisquare(df - np.arange(p)))
    low = np.linalg.cholesky(scale)
    half = np.linalg.solve(a, low.T)  # W^-1 = (L A^-T)(L A^-T)'
    return half.T @ half


def log_gamma_p(p: int, x: float) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - i / 2) for i in range(p))


def inverse_wishart_logpdf(x: np.ndarray, df: float, scale: np.ndarray) -> float:
    p = len(x)
    low, own = np.linalg.cholesky(x), np.linalg.cholesky(scale)
    log_x, log_s = 2 * np.log(np.diag(low)).sum(), 2 * np.log(np.diag(own)).sum()
    white = np.linalg.solve(low, own)
    return float(df / 2 * log_s - df * p / 2 * math.log(2) - log_gamma_p(p, df / 2) - (df + p + 1) / 2 * log_x - 0.5 * (white * white).sum())


def unpacked(x: np.ndarray, p: int) -> np.ndarray:
    """Lower triangle from its packed rows, the diagonal in logs."""
    low = np.zeros((p, p))
    low[np.tril_indices(p)] = x
    low[np.arange(p), np.arange(p)] = np.exp(np.diag(low))
    return low


def packed(low: np.ndarray) -> np.ndarray:
    flat = low.copy()
    flat[np.arange(len(low)), np.arange(len(low))] = np.log(np.diag(low))
    return flat[np.tril_indices(len(low))]


def cholesky_jacobian(low: np.ndarray) -> float:
    """log |d vech(L L') / d packed(L)| with logs on the diagonal: p log 2 + sum (p - i + 2) log L_ii, i from 1."""
    p = len(low)
    return p * math.log(2) + float(((p - np.arange(p) + 1) * np.log(np.diag(low))).sum())


def packed_inverse_wishart_logpdf(x: np.ndarray, df: float, scale: np.ndarray) -> float:
    """Density of packed(L) where L L' is inverse Wishart; flat coordinates otherwise."""
    low = unpacked(x, len(scale))
    return inverse_wishart_logpdf(low @ low.T, df, scale) + cholesky_jacobian(low)


def packed_inverse_wishart_gradient(x: np.ndarray, df: float, scale: np.ndarray) -> np.ndarray:
    """Gradient of that log density in the packed coordinates."""
    p = len(scale)
    low = unpacked(x, p)
    inverse = spd_inverse(low @ low.T)
    sigma = 0.5 * (inverse @ scale @ inverse - (df + p + 1) * inverse)
    return packed_gradient(low, sigma, p - np.arange(p) + 1.0)


def packed_gradient(low: np.ndarray, sigma: np.ndarray, jacobian: np.ndarray | float = 0.0) -> np.ndarray:
    """From a gradient in sigma = L L' to one in packed(L); jacobian is what the logs of the diagonal add."""
    g = np.tril((sigma + sigma.T) @ low)
    at = np.arange(len(low))
    g[at, at] = np.diag(g) * np.diag(low) + jacobian
    return g[np.tril_indices(len(low))]


def sigma_reference(r: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factor of the sample covariance of least-squares residuals, and the scales of its packed coordinates.

    A diagonal entry's logarithm varies by 1/sqrt(2 T), another entry by its column's diagonal over sqrt(T).
    """
    from .priors import least_squares

    e = residuals(r, f, least_squares(r, f))
    low = np.linalg.cholesky(np.atleast_2d(np.cov(e, ddof=1)))
    months = r.shape[1]
    scale = np.tile(np.diag(low) / math.sqrt(months), (len(low), 1))
    np.fill_diagonal(scale, 1 / math.sqrt(2 * months))
    return low, scale[np.tril_indices(len(low))]


def data_precision(f: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Precision that the data give all coefficients: Sigma^-1[i, j] f_i'f_j."""
    n, t, k = f.shape
    g, _ = cross_products(f, np.zeros((n, t)))
    return (spd_inverse(sigma)[:, None, :, None] * g).reshape(n * k, n * k)


def eigen_route(f: np.ndarray, sigma: np.ndarray) -> float:
    """Median eigenvalue of the data precision, as a standard deviation."""
    return float(1 / math.sqrt(np.median(np.linalg.eigvalsh(data_precision(f, sigma)))))
