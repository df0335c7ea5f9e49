"""Special functions of single numbers, accurate in both tails. Built on the standard library's lgamma and erfc."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

#: Relative change at which a series or continued fraction has settled, and the terms after which it must have.
SETTLED, MOST_TERMS = 1e-15, 100_000


def _fraction(term: Callable[[int], tuple[float, float]]) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + …)) where ``term(k)`` is (a_k, b_k) and a_0 counts nothing; evaluated forwards."""
    tiny = 1e-300
    value = term(0)[1] or tiny
    up, down = value, 0.0
    for k in range(1, MOST_TERMS):
        a, b = term(k)
        down = 1 / ((b + a * down) or tiny)
        up = (b + a / up) or tiny
        value *= up * down
        if abs(up * down - 1) < SETTLED:
            return value
    raise ArithmeticError("the continued fraction did not settle")


def gamma_tails(a: float, x: float) -> tuple[float, float]:
    """Regularised lower and upper incomplete gamma function of a > 0."""
    if x <= 0:
        return 0.0, 1.0
    if math.isinf(x):
        return 1.0, 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * SETTLED:
            k += 1
            term *= x / k
            total += term
        low = min(front * total, 1.0)
        return low, 1 - low
    # 1/(x+1-a - 1(1-a)/(x+3-a - 2(2-a)/(x+5-a - …
    high = min(front / _fraction(lambda k: (k * (a - k), x + 2 * k + 1 - a)), 1.0)
    return 1 - high, high


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k == 0:
            return 0.0, 1.0
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front / (a * _fraction(term))


def lgamma(x: float) -> float:
    return math.lgamma(x) if x > 0 or x != math.floor(x) else math.nan


def norm_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def norm_p2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def norm_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.nan


def t_p2(t: float, df: float) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5) if df > 0 else math.nan


def t_cdf(t: float, df: float) -> float:
    half = t_p2(t, df) / 2
    return 1 - half if t > 0 else half


def t_quantile(p: float, df: float) -> float:
    """By bisection between ends that are doubled until they hold the quantile."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    tail, lo, hi = 2 * (1 - p), 0.0, 1.0
    while t_p2(hi, df) > tail:
        lo, hi = hi, hi * 2
    while hi - lo > 1e-13 * hi:
        middle = (lo + hi) / 2
        if middle in (lo, hi):
            break
        lo, hi = (middle, hi) if t_p2(middle, df) > tail else (lo, middle)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    return gamma_tails(df / 2, x / 2)[1] if df > 0 else math.nan


def f_sf(f: float, d1: float, d2: float) -> float:
    if d1 <= 0 or d2 <= 0:
        return math.nan
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_p(a: float, b: float, c: float, d: float) -> float:
    """Two-sided exact p of a 2x2 table: the tables with its margins that are no likelier than it.

    Chances fall away from the likeliest table on both sides, so each tail is summed from its inner end until terms no
    longer count; large tables cost no more than small ones.
    """
    r, s, k = a + b, c + d, a + c
    if min(a, b, c, d) < 0 or r + s == 0:
        return math.nan
    lo, hi = int(max(0, k - s)), int(min(r, k))
    whole = log_choose(r + s, k)
    chance = lambda x: log_choose(r, x) + log_choose(s, k - x) - whole
    most = chance(a) + 1e-9
    top = min(max(int((k + 1) * (r + 1) / (r + s + 2)), lo), hi)

    def tail(start: int, stop: int, step: int) -> float:
        """Sum of the chances no greater than the observed one between the likeliest table and an end."""
        near, far = start, stop
        if (far - near) * step < 0 or chance(far) > most:
            return 0.0
        while near != far:  # the innermost table that counts
            middle = (near + far) // 2 if step > 0 else -((-near - far) // 2)
            if chance(middle) <= most:
                far = middle
            else:
                near = middle + step
        total, x = 0.0, far
        while (stop - x) * step >= 0:
            p = math.exp(chance(x))
            total += p
            if p < total * 1e-17:
                break
            x += step
        return total

    return min(1.0, tail(top, hi, 1) + tail(top - 1, lo, -1))
