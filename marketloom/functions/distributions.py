"""Distribution functions for the tests' p-values, in plain Python.

The incomplete gamma and beta functions use their textbook series and continued
fractions; arguments are single numbers that jobs have already aggregated.
"""

from __future__ import annotations

import math

_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - lead * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h, i = d, 0
    while True:
        i += 1
        b += 2
        d = 1 / _nonzero(-i * (i - a) * d + b)
        c = _nonzero(b - i * (i - a) / c)
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            return lead * h


def _nonzero(x: float) -> float:
    return x if abs(x) > _TINY else _TINY


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    c, d, h = 1.0, 1 / _nonzero(1 - (a + b) * x / (a + 1)), 1.0
    h = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _nonzero(1 + top * d)
            c = _nonzero(1 + top / c)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h / a


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))
