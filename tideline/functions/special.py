"""Distribution functions as Column expressions: normal, chi-squared and F.

Continued fractions run over a fixed sequence with ``F.aggregate``, so they stay
in the engine and in the plan. Null arguments give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series or fraction; degrees of freedom from which the F distribution counts as its limit, the chi-squared.
TERMS, LIMIT_DF = 400, 1e6
_TINY = 1e-300

#: Lanczos' coefficients (g = 7, n = 9).
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
#: Acklam's rational approximation of the normal quantile: centre (numerator, denominator), tails (the same).
ACKLAM = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0],
)
ACKLAM_EDGE = 0.02425


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The normal distribution's quantile by Acklam's approximation (relative error below 1.2e-9); null outside (0, 1)."""
    a, b, c, d = ACKLAM
    centre = p - F.lit(0.5)
    square = centre * centre
    middle = _polynomial(a, square) * centre / _polynomial(b, square)
    tail = lambda q: _polynomial(c, q) / _polynomial(d, q)
    low, high = tail(F.sqrt(F.lit(-2.0) * F.log(p))), -tail(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p)))
    inside = F.when(p < ACKLAM_EDGE, low).when(p > 1 - ACKLAM_EDGE, high).otherwise(middle)
    return F.when((p > 0) & (p < 1), inside)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    y = x - F.lit(1.0)
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + F.lit(float(i)))
    t = y + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + F.lit(0.5)) * F.log(t) - t + F.log(total)


def _steps(first: int = 1) -> Column:
    return F.sequence(F.lit(first), F.lit(first + TERMS - 1))


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def gamma_q(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function: by its series below a + 1, by its continued fraction beyond."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    state = F.struct(F.lit(1.0) / a, F.lit(1.0) / a)
    series = F.aggregate(_steps(), state.cast("struct<term:double,total:double>"), lambda s, k: _series(s, k, a, x), lambda s: s["total"])
    b = x + F.lit(1.0) - a
    start = F.struct(b, F.lit(1 / _TINY), F.lit(1.0) / _safe(b), F.lit(1.0) / _safe(b)).cast("struct<b:double,c:double,d:double,h:double>")
    fraction = F.aggregate(_steps(), start, lambda s, k: _gamma_step(s, k, a), lambda s: s["h"])
    return F.when(x <= 0, F.lit(1.0)).when(x < a + F.lit(1.0), F.lit(1.0) - series * front).otherwise(fraction * front)


def _series(s: Column, k: Column, a: Column, x: Column) -> Column:
    term = s["term"] * x / (a + k.cast("double"))
    return F.struct(term, s["total"] + term).cast("struct<term:double,total:double>")


def _gamma_step(s: Column, k: Column, a: Column) -> Column:
    k = k.cast("double")
    factor = -k * (k - a)
    b = s["b"] + F.lit(2.0)
    d = F.lit(1.0) / _safe(factor * s["d"] + b)
    c = _safe(b + factor / s["c"])
    return F.struct(b, c, d, s["h"] * c * d).cast("struct<b:double,c:double,d:double,h:double>")


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X >= x) of the chi-squared distribution."""
    return gamma_q(df.cast("double") / 2, x.cast("double") / 2)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    kind = "struct<c:double,d:double,h:double>"
    d = F.lit(1.0) / _safe(F.lit(1.0) - (a + b) * x / (a + F.lit(1.0)))

    def half(s: Column, n: Column) -> Column:
        d = F.lit(1.0) / _safe(F.lit(1.0) + n * s["d"])
        c = _safe(F.lit(1.0) + n / s["c"])
        return F.struct(c, d, s["h"] * c * d).cast(kind)

    def step(s: Column, k: Column) -> Column:
        # odd steps are the first half of a pair, even ones the second: nesting both would copy the state's expressions
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(k % 2 == 0, even).otherwise(odd))

    steps = F.sequence(F.lit(2), F.lit(2 * TERMS + 1))
    return F.aggregate(steps, F.struct(F.lit(1.0), d, d).cast(kind), step, lambda s: s["h"])


def beta_i(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    left = front * _beta_fraction(x, a, b) / a
    right = F.lit(1.0) - front * _beta_fraction(F.lit(1.0) - x, b, a) / b
    inside = F.when(x > (a + F.lit(1.0)) / (a + b + F.lit(2.0)), right).otherwise(left)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def f_sf(x: Column, d1: Column, d2: Column) -> Column:
    """P(X >= x) of the F distribution. From ``LIMIT_DF`` denominator degrees on it counts as its limit, with an error of about 1 / d2."""
    x, d1, d2 = x.cast("double"), d1.cast("double"), d2.cast("double")
    exact = beta_i(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)
    return F.when(x <= 0, F.lit(1.0)).when(d2 >= LIMIT_DF, chi2_sf(d1 * x, d1)).otherwise(exact)
