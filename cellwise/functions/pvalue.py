"""Tail probabilities for result rows (a handful of rows per study)."""

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _guard(v: float) -> float:
    return v if abs(v) > _TINY else _TINY


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function."""
    c, d = 1.0, 1.0 / _guard(1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coef in (even, odd):
            d = 1.0 / _guard(1.0 + coef * d)
            c = _guard(1.0 + coef / c)
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation coefficient by the t approximation."""
    if math.isnan(r) or math.isnan(n) or n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    return beta_inc(df / 2.0, 0.5, df / (df + r * r * df / (1.0 - r * r)))


def normal_p(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def p_correlation(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(float(a), float(b)) for a, b in zip(r, n)], dtype="float64")


def inversions(n: int) -> list[int]:
    """How many orders of ``n`` values have 0, 1, 2, ... inversions."""
    counts = [1]
    for m in range(2, n + 1):
        longer = [0] * (len(counts) + m - 1)
        for k, c in enumerate(counts):
            for shift in range(m):
                longer[k + shift] += c
        counts = longer
    return counts


def kendall_p(a: Sequence[float], b: Sequence[float]) -> float | None:
    """Two-sided p of Kendall's tau: exact for at most 33 values without ties, else normal with tie corrections.

    None where tau is undefined: fewer than two values, or one vector constant.
    """
    n = len(a)
    if n < 2 or n != len(b) or any(x is None for x in (*a, *b)):
        return None
    a, b = [float(x) for x in a], [float(x) for x in b]
    ties_a, ties_b = (list(Counter(v).values()) for v in (a, b))
    if len(ties_a) == 1 or len(ties_b) == 1:
        return None
    sign = lambda x: (x > 0) - (x < 0)
    score = sum(sign(a[i] - a[j]) * sign(b[i] - b[j]) for i in range(n) for j in range(i))
    pairs = n * (n - 1) // 2
    if max(ties_a + ties_b) == 1 and n <= 33:
        counts = inversions(n)
        low = (pairs - abs(score)) // 2
        return min(1.0, 2.0 * sum(counts[:low + 1]) / sum(counts))
    tied = lambda ties, f: sum(f(t) for t in ties)
    spread = lambda t: t * (t - 1) * (2 * t + 5)
    two, three = (lambda t: t * (t - 1)), (lambda t: t * (t - 1) * (t - 2))
    variance = (spread(n) - tied(ties_a, spread) - tied(ties_b, spread)) / 18 + tied(ties_a, two) * tied(ties_b, two) / (2 * two(n))
    if n > 2:
        variance += tied(ties_a, three) * tied(ties_b, three) / (9 * three(n))
    return normal_p(score / math.sqrt(variance))


@F.pandas_udf(T.DoubleType())
def p_kendall(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kendall_p(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")
