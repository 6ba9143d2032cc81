"""lgamma, digamma-free density helpers, erf and log-sum-exp as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7, n = 9.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0; null otherwise. Below 1/2 by the recurrence lgamma(x + 1) - log x."""
    z = F.when(x < 0.5, x + 1).otherwise(x) - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    big = 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)
    return F.when(x > 0, F.when(x < 0.5, big - F.log(x)).otherwise(big))


#: Numerators and denominators of rational approximations of erf up to NEAR, in x squared, and of
#: erfc times exp of x squared beyond, in x; errors are about 1e-16.
NEAR = 0.46875
ERF_NEAR = ([0.185777706184603153, 3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947], [1.0, 23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062])
ERFC_FAR = (
    [2.15311535474403846e-8, 0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725],
    [1.0, 15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942],
)


def erf(x: Column) -> Column:
    """erf by rational approximations up to |x| = 3, by the first terms of its tail's series beyond."""
    a = F.abs(x)
    near = a * _horner(a * a, ERF_NEAR[0]) / _horner(a * a, ERF_NEAR[1])
    middle = 1 - F.exp(-a * a) * _horner(a, ERFC_FAR[0]) / _horner(a, ERFC_FAR[1])
    tail = 1 - F.exp(-a * a) / (a * math.sqrt(math.pi)) * (1 - 1 / (2 * a * a) + 3 / (4 * a * a * a * a) - 15 / (8 * a**6))
    return F.signum(x) * F.when(a <= NEAR, near).when(a <= 3, middle).when(a > 6, F.lit(1.0)).otherwise(tail)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def logsumexp(x: Column, over=None) -> Column:
    """log sum exp(x), stable: as an aggregate from array-free max and sum, so two passes in one stage."""
    values = F.collect_list(x) if over is None else F.collect_list(x).over(over)
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


#: Coefficients of a rational approximation of the normal quantile (relative error under 1.2e-9):
#: numerator and denominator in the middle, then in the tails, which begin at TAIL.
QUANTILE_MIDDLE = ([-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239], [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0])
QUANTILE_TAIL = ([-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783], [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0])
TAIL = 0.02425


def _horner(x: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_quantile(u: Column) -> Column:
    """The value that a standard normal stays under with probability u, 0 < u < 1."""
    q = u - 0.5
    middle = q * _horner(q * q, QUANTILE_MIDDLE[0]) / _horner(q * q, QUANTILE_MIDDLE[1])
    t = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = _horner(t, QUANTILE_TAIL[0]) / _horner(t, QUANTILE_TAIL[1])
    return F.when(F.abs(q) <= 0.5 - TAIL, middle).otherwise(-F.signum(q) * tail)


def t4_quantile(u: Column) -> Column:
    """The same for a student-t of four degrees of freedom, in closed form."""
    a = F.sqrt(4 * u * (1 - u))
    return F.signum(u - 0.5) * 2 * F.sqrt(F.greatest(F.cos(F.acos(F.least(a, F.lit(1.0))) / 3) / a - 1, F.lit(0.0)))


def hashed_uniform(*keys: Column) -> Column:
    """A uniform number in (0, 1) that depends on the keys alone, not on partitions or the order of rows:
    the first 32 bits of the md5 of the keys joined by colons."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8), 16, 10)
    return (h.cast("double") + 0.5) / 4294967296.0
