"""Log-densities as Column expressions; a missing value contributes 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochlane.functions.special import lgamma, normal_cdf

EPS = 1e-6


def _or_zero(y: Column, ll: Column) -> Column:
    return F.when(y.isNull(), 0.0).otherwise(ll)


def normal(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return _or_zero(y, -0.5 * math.log(2 * math.pi) - F.log(sigma) - z * z / 2)


def lognormal(y: Column, mu: Column, sigma: Column, eps: float = EPS) -> Column:
    safe = F.greatest(y, F.lit(eps))
    return _or_zero(y, normal(F.log(safe), mu, sigma) - F.log(safe))


def student_t(y: Column, nu: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return _or_zero(y, lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(sigma) - (nu + 1) / 2 * F.log1p(z * z / nu))


def gamma(y: Column, alpha: Column, beta: Column, eps: float = EPS) -> Column:
    safe = F.greatest(y, F.lit(eps))
    return _or_zero(y, alpha * F.log(beta) - lgamma(alpha) + (alpha - 1) * F.log(safe) - beta * safe)


def beta(y: Column, a: Column, b: Column, eps: float = EPS, support_upper: float = 1.0) -> Column:
    """Of y / support_upper, clipped to [eps, 1 - eps], without a Jacobian term."""
    x = F.least(F.greatest(y / support_upper, F.lit(eps)), F.lit(1 - eps))
    return _or_zero(y, lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * F.log(x) + (b - 1) * F.log(1 - x))


def interval_inflated_beta(y: Column, pi: Column, a: Column, b: Column, threshold: float = 0.9, mixture: bool = False) -> Column:
    """piecewise: pi spread over [threshold, 1], 1 - pi times Beta below; mixture: Beta everywhere."""
    low, up = F.log(1 - pi) + beta(y, a, b), F.log(pi) - math.log(1 - threshold)
    if mixture:
        return _or_zero(y, F.when(y >= threshold, F.log(F.exp(low) + F.exp(up))).otherwise(low))
    return _or_zero(y, F.when(y >= threshold, up).otherwise(low))


def zero_inflated_beta(y: Column, pi: Column, a: Column, b: Column, eps: float = EPS) -> Column:
    return _or_zero(y, F.when(y <= eps, F.log(pi)).otherwise(F.log(1 - pi) + beta(y, a, b, eps)))


def skew_normal(y: Column, mu: Column, sigma: Column, alpha: Column) -> Column:
    z = (y - mu) / sigma
    return _or_zero(y, math.log(2) + normal(y, mu, sigma) + F.log(F.greatest(normal_cdf(alpha * z), F.lit(1e-300))))


def _log_gamma_share(a: float, x: float) -> float:
    """The share of a gamma(a, 1) under x, by its series."""
    total, term, k = 0.0, 1.0 / a, 0
    while term > 1e-17 * total or k < x:
        total += term
        k += 1
        term *= x / (a + k)
        if k > 10_000:
            break
    return math.exp(a * math.log(x) - x - math.lgamma(a)) * total if x > 0 else 0.0


def _shape_rate(p: dict[str, float]) -> tuple[float, float]:
    """A gamma's shape and rate, given as such (alpha, beta) or by mean and deviation (mu, sigma)."""
    if "alpha" in p and "beta" in p:
        return p["alpha"], p["beta"]
    return p["mu"] ** 2 / p["sigma"] ** 2, p["mu"] / p["sigma"] ** 2


def prior(x: Column, dist: str, **p: float) -> Column:
    """Log-density of a prior at x; null outside its support. Families and their parameters:

    normal (mu, sigma), halfnormal (sigma), halfstudentt (nu, sigma), exponential (lam), exponential_plus (lam, offset),
    lognormal (mu, sigma), beta (alpha, beta), gamma (alpha and beta, or mu and sigma), gamma_offset (the same, offset) and
    truncated_gamma (the same, lower, and upper if there's an end)."""
    at = lambda low: F.when(x >= low, x)
    if dist == "normal":
        return _none(x, normal(x, F.lit(p["mu"]), F.lit(p["sigma"])))
    if dist == "halfnormal":
        return _none(at(0.0), math.log(2) + normal(x, F.lit(0.0), F.lit(p["sigma"])))
    if dist == "halfstudentt":
        return _none(at(0.0), math.log(2) + student_t(x, F.lit(p["nu"]), F.lit(0.0), F.lit(p["sigma"])))
    if dist in ("exponential", "exponential_plus"):
        low = p.get("offset", 0.0)
        return _none(at(low), math.log(p["lam"]) - p["lam"] * (x - low))
    if dist == "lognormal":
        return _none(F.when(x > 0, x), lognormal(x, F.lit(p["mu"]), F.lit(p["sigma"]), 1e-300))
    if dist == "beta":
        return _none(F.when((x > 0) & (x < 1), x), beta(x, F.lit(p["alpha"]), F.lit(p["beta"]), 1e-300))
    if dist in ("gamma", "gamma_offset", "truncated_gamma"):
        a, b = _shape_rate(p)
        low = p.get("offset", 1.0) if dist == "gamma_offset" else 0.0
        out = _none(F.when(x > low, x), gamma(x - low, F.lit(a), F.lit(b), 1e-300))
        if dist != "truncated_gamma":
            return out
        lower, upper = p.get("lower", 1.0), p.get("upper", math.inf)
        held = (_log_gamma_share(a, b * upper) if upper < math.inf else 1.0) - _log_gamma_share(a, b * lower)
        return F.when((x >= lower) & (x <= upper), out - math.log(held))
    raise ValueError(f"unknown prior {dist}")


def _none(there: Column, ll: Column) -> Column:
    return F.when(there.isNotNull(), ll)
