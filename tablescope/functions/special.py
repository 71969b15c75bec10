"""Tail probabilities of the t, F, chi-square and normal distributions.

Only ever evaluated on the driver, on the handful of numbers an aggregate
returned.  Continued fractions follow Lentz's method as published in the
numerical literature (Abramowitz & Stegun 6.5.31 and 26.5.8).
"""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300
_EPS = 1e-16
_STD_NORMAL = NormalDist()


def _lentz(first: float, terms) -> float:
    """Evaluate first + a1/(b1 + a2/(b2 + ...)) for the (a, b) pairs in ``terms``."""
    value = first or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < _EPS:
            break
    return value


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(1.0 - x, b, a)

    def terms():
        for m in range(1, 10_000):
            k = m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            else:
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return math.exp(log_front) / (a * _lentz(1.0, terms()))


def regularized_gamma_upper(a: float, x: float) -> float:
    """Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)
    tail = _lentz(x + 1.0 - a, ((-k * (k - a), x + 2 * k + 1.0 - a) for k in range(1, 10_000)))
    return math.exp(log_front) / tail


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return regularized_beta(dof / (dof + t * t), dof / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return regularized_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, dof: float) -> float:
    return regularized_gamma_upper(dof / 2.0, x / 2.0)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_density(z: float) -> float:
    return math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)


def normal_quantile(p: float) -> float:
    return _STD_NORMAL.inv_cdf(p)


def t_quantile(p: float, dof: float) -> float:
    """Upper half of the t quantile function (p >= 0.5), by bisection."""
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, dof) / 2.0 < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, dof) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def correlation_p_value(r: float, n: int) -> float | None:
    """Two-sided p of a correlation over n pairs."""
    if n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
