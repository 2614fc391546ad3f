"""Distribution functions for the last step of a test, on the driver: one number in, one number out."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

_TINY = 1e-300


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + top / c
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return min(1.0, front * out)


def gammainc_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 100_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-17:
                break
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1 / _TINY
    d = out = 1 / b
    for n in range(1, 100_000):
        top = -n * (n - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + top / c
        c = c if abs(c) > _TINY else _TINY
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return min(1.0, scale * out)


def student_t_sf(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def student_t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection of its distribution function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -student_t_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while student_t_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def f_sf(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2, x / 2)


def two_sided(p_greater: float, p_less: float, alternative: str) -> float:
    if alternative == "greater":
        return p_greater
    if alternative == "less":
        return p_less
    if alternative != "two-sided":
        raise ValueError(f"unknown alternative {alternative!r}")
    return min(1.0, 2 * min(p_greater, p_less))


def kolmogorov_sf(x: float) -> float:
    """Tail of the limiting Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    if x < 1.18:
        base = math.exp(-math.pi**2 / (8 * x * x))
        return 1 - math.sqrt(2 * math.pi) / x * sum(base ** ((2 * k - 1) ** 2) for k in range(1, 8))
    return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 20))


def ks_one_sample_sf(d: float, n: int) -> float:
    """Two-sided tail of the one-sample statistic: exact for small samples (Marsaglia, Tsang and Wang), else the
    limit with Stephens' correction."""
    if d <= 0:
        return 1.0
    if n <= 140:
        k = int(n * d) + 1
        m, h = 2 * k - 1, k - n * d
        matrix = [[1.0 if i - j + 1 >= 0 else 0.0 for j in range(m)] for i in range(m)]
        for i in range(m):
            matrix[i][0] -= h ** (i + 1)
            matrix[m - 1][i] -= h ** (m - i)
        matrix[m - 1][0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0
        for i in range(m):
            for j in range(m):
                if i - j + 1 > 0:
                    matrix[i][j] /= math.factorial(i - j + 1)
        power = _matrix_power(matrix, n)
        value = power[k - 1][k - 1]
        for i in range(1, n + 1):
            value *= i / n
        return min(1.0, max(0.0, 1 - value))
    root = math.sqrt(n)
    return min(1.0, kolmogorov_sf((root + 0.12 + 0.11 / root) * d))


def _matrix_power(a: list[list[float]], n: int) -> list[list[float]]:
    import numpy as np

    return np.linalg.matrix_power(np.array(a), n).tolist()


def ks_two_sample_sf(d: float, n1: int, n2: int, alternative: str = "two-sided") -> float:
    """Exact for two-sided samples of up to 10,000 steps in the lattice, else asymptotic."""
    if alternative != "two-sided":
        z = math.sqrt(n1 * n2 / (n1 + n2)) * d
        return math.exp(-2 * z * z - 2 * z * (n1 + 2 * n2) / math.sqrt(n1 * n2 * (n1 + n2)) / 3) if max(n1, n2) > 10_000 or n1 != n2 else math.exp(-2 * z * z)
    if n1 * n2 <= 1_000_000:
        return _ks_exact(d, n1, n2)
    return min(1.0, max(0.0, kolmogorov_sf(math.sqrt(n1 * n2 / (n1 + n2)) * d)))


def _ks_exact(d: float, n1: int, n2: int) -> float:
    """Share of lattice paths that leave the band |i/n1 - j/n2| < d."""
    limit = round(d * n1 * n2)
    row = [0.0] * (n2 + 1)
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if abs(i * n2 - j * n1) >= limit and limit > 0:
                row[j] = 1.0
            elif i == 0 and j == 0:
                row[j] = 0.0
            elif i == 0:
                row[j] = row[j - 1]
            elif j:
                row[j] = (row[j] * i + row[j - 1] * j) / (i + j)
    return min(1.0, row[n2])


def hypergeometric_pmf(k: int, total: int, good: int, drawn: int) -> float:
    if k < max(0, drawn + good - total) or k > min(good, drawn):
        return 0.0
    c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return math.exp(c(good, k) + c(total - good, drawn - k) - c(total, drawn))


def fisher_exact_p(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    total, good, drawn = a + b + c + d, a + b, a + c
    ks = range(max(0, drawn + good - total), min(good, drawn) + 1)
    p = {k: hypergeometric_pmf(k, total, good, drawn) for k in ks}
    if alternative == "less":
        return min(1.0, sum(x for k, x in p.items() if k <= a))
    if alternative == "greater":
        return min(1.0, sum(x for k, x in p.items() if k >= a))
    return min(1.0, sum(x for x in p.values() if x <= p[a] * (1 + 1e-7)))


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coins."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k, n + 1)))


@lru_cache(maxsize=64)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    counts = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(counts) - 1, k - 1, -1):
            counts[s] += counts[s - k]
    return tuple(counts)


def signed_rank_sf(w: int, n: int) -> float:
    """P(W+ >= w) without ties and zeros."""
    counts = _signed_rank_counts(n)
    return sum(counts[max(0, w) :]) / 2**n


@lru_cache(maxsize=64)
def _rank_sum_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many orders give each value of U."""
    table = [[[1] for _ in range(n2 + 1)] for _ in range(n1 + 1)]
    for i in range(1, n1 + 1):
        for j in range(1, n2 + 1):
            out = [0] * (i * j + 1)
            for u, x in enumerate(table[i - 1][j]):
                out[u + j] += x
            for u, x in enumerate(table[i][j - 1]):
                out[u] += x
            table[i][j] = out
    return tuple(table[n1][n2])


def rank_sum_sf(u: int, n1: int, n2: int) -> float:
    counts = _rank_sum_counts(n1, n2)
    return sum(counts[max(0, u) :]) / math.comb(n1 + n2, n1)


def shapiro_wilk(x: list[float]) -> tuple[float, float]:
    """W and p by Royston's approximation (algorithm AS R94), for 3 to 5000 values."""
    x = sorted(x)
    n = len(x)
    if n < 3:
        raise ValueError("at least 3 values are needed")
    if x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = poly((m[-1] / math.sqrt(square), 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), u)
        if n > 5:
            second = poly((m[-2] / math.sqrt(square), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *[v / math.sqrt(phi) for v in m[2:-2]], second, last]
        else:
            phi = (square - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
    mean = math.fsum(x) / n
    w = math.fsum(p * q for p, q in zip(a, x, strict=True)) ** 2 / math.fsum((v - mean) ** 2 for v in x)
    w = min(w, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = math.log(1 - w)
        if y >= gamma:
            return w, 1e-99
        z = -math.log(gamma - y)
        mu, sigma = poly((0.5440, -0.39978, 0.025054, -6.714e-4), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        v = math.log(n)
        z = math.log(1 - w)
        mu, sigma = poly((-1.5861, -0.31082, -0.083751, 0.0038915), v), math.exp(poly((-0.4803, -0.082676, 0.0030302), v))
    return w, normal_sf((z - mu) / sigma)
