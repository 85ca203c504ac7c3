"""Scalar column expressions that Spark lacks, and the shrinkage formulas; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26 (error function) and Acklam's rational normal quantile.
ERF_P = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
QA = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
QB = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
QC = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QD = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
TAIL = 0.02425


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    """Polynomial with the highest power's coefficient first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) within 7.5e-8; null for null."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    erf = F.lit(1.0) - horner(tuple(reversed(ERF)), t) * t * F.exp(-z * z)
    return F.when(x >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal CDF within 1.2e-9 relative, for 0 < p < 1; null outside."""
    low, high = F.sqrt(F.lit(-2.0) * F.ln(p)), F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    tail = lambda r: horner(QC, r) / horner((*QD, 1.0), r)
    middle = horner(QA, q * q) * q / horner((*QB, 1.0), q * q)
    inside = F.when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(middle)
    return F.when((p > 0) & (p < 1), inside)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)


def log_positive(x: Column) -> Column:
    """ln(x), null unless x > 0."""
    return F.when(x > 0, F.ln(x))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def residual(r: Column, f: Column, b: Column) -> Column:
    return r - dot(f, b)


def slab_binding_probability(tau: Column, c: Column) -> Column:
    """Probability 2/pi atan(tau / c) that a half-Cauchy local scale exceeds the slab."""
    return F.lit(2.0) / F.pi() * F.atan(tau / c)


def regularised_scale(lam: Column, tau: Column, c: Column) -> Column:
    """sqrt(c^2 l^2 / (c^2 + tau^2 l^2)): the local scale with the slab's ceiling."""
    return F.sqrt(c * c * lam * lam / (c * c + tau * tau * lam * lam))


def shrinkage(n: Column, sigma: Column, tau: Column, lam: Column, s: Column) -> Column:
    """kappa = 1 / (1 + a^2), a = sqrt(n) / sigma * tau * lam * s."""
    a = F.sqrt(n) / sigma * tau * lam * s
    return F.lit(1.0) / (F.lit(1.0) + a * a)


def shrinkage_from_variance(n: Column, sigma2: Column, variance: Column, s2: Column) -> Column:
    """kappa of a coefficient with this prior variance: 1 / (1 + n s^2 v / sigma^2)."""
    return F.lit(1.0) / (F.lit(1.0) + n * s2 * variance / sigma2)


def effective_size(n: Column, sigma: Column, tau: Column, s: Column) -> Column:
    """a / (1 + a) with a = sqrt(n) / sigma * tau * s: a coefficient's part of the effective number of them."""
    a = F.sqrt(n) / sigma * tau * s
    return a / (F.lit(1.0) + a)


def decimal_year(month: Column) -> Column:
    return F.year(month) + (F.month(month) - 1) / F.lit(12.0)


def clean_number(text: Column) -> Column:
    """Text with padding and thousands separators as a double; what isn't a number is null, and so is NaN."""
    x = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(x), x)
