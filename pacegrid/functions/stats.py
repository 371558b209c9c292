"""Statistics as column expressions that give null, not an error, where they are undefined, and p-values in plain Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are there; null when either is constant (corr itself fails there under ANSI rules)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a).cast("double"), F.when(both, b).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def rounded(c: Column, digits: int) -> Column:
    """Halves up, by plain arithmetic: F.round writes each number out as a decimal, which costs more than all else of a pair."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def avg_rank(order: Column, *group: str) -> Column:
    """The rank within the group, ties sharing the mean of their ranks."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(w.orderBy(order).rangeBetween(0, 0)) - 1) / F.lit(2.0)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine: 13 hex digits over 2^52."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def signed_rank_sf(w_plus: float, n: int) -> float:
    """P(W+ >= w_plus) under the null: the exact count up to 50 pairs, else by the normal curve."""
    if n > 50:
        mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
        return normal_sf((w_plus - mean - 0.5) / math.sqrt(var))
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(ways) - 1, k - 1, -1):
            ways[s] += ways[s - k]
    return sum(ways[math.ceil(w_plus) :]) / 2**n


def student_sf(t: float, df: int) -> float:
    """P(T >= t), by the continued fraction of the incomplete beta function."""
    if df <= 0:
        return float("nan")
    x = df / (df + t * t)
    p = 0.5 * _beta(x, df / 2, 0.5)
    return p if t >= 0 else 1 - p


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(1 - x, b, a) / b


def _fraction(x: float, a: float, b: float) -> float:
    """Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out
