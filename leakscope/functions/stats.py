"""Statistics that neither Spark nor the SQL twin has: normal tails, Kolmogorov and Shapiro-Wilk p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Fixed value: the log p-value that stands for an underflow, and the p below which it does.
UNDERFLOW, UNDERFLOW_P = -115.13, 1e-50

#: Cody's rational approximations of the error function near zero, in the middle, and in the tail,
#: numerators and denominators from the highest power down; relative error below 1e-15.
NEAR = ([1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
TAIL = (
    [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4],
    [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3],
)
NEAR_END, MIDDLE_END, ROOT_PI = 0.46875, 4.0, 5.6418958354775628695e-1


def _horner(coefficients: list[float], x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    """Complementary error function from built-in functions; null stays null."""
    y = F.abs(x)
    far = F.greatest(y, F.lit(NEAR_END))
    square, inverse = y * y, 1 / (far * far)
    grid = F.floor(far * 16) / 16
    decay = F.exp(-grid * grid) * F.exp(-(far - grid) * (far + grid))
    middle = decay * _horner(MIDDLE[0], far) / _horner(MIDDLE[1], far)
    tail = decay * (ROOT_PI - inverse * _horner(TAIL[0], inverse) / _horner(TAIL[1], inverse)) / far
    outer = F.when(y <= MIDDLE_END, middle).otherwise(tail)
    return F.when(y <= NEAR_END, 1 - x * _horner(NEAR[0], square) / _horner(NEAR[1], square)).when(x < 0, 2 - outer).otherwise(outer)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; null stays null.

    The lambda evaluates z once: inlined, the polynomials would repeat it some sixty times and
    outgrow what one generated method may hold.
    """
    return F.transform(F.array(-z / math.sqrt(2)), lambda x: 0.5 * erfc(x))[0]


def upper_ps(*z: Column) -> Column:
    """Array of 1 - cdf of each z, which underflows to 0 beyond about 8.3 standard deviations, as reports do."""
    return F.transform(F.array(*z), lambda x: 1 - 0.5 * erfc(-x / math.sqrt(2)))


def neg_log(p: Column) -> Column:
    """-ln of a tail, 115.13 where it underflows."""
    return F.when(p < UNDERFLOW_P, F.lit(-UNDERFLOW)).otherwise(-F.log(F.when(p >= UNDERFLOW_P, p)))


def log_density(x: Column, mean: Column, sd: Column) -> Column:
    """Log of the normal density."""
    z = (x - mean) / sd
    return -0.5 * z * z - F.log(sd) - F.lit(0.5 * math.log(2 * math.pi))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic d of sizes n and m."""
    t = F.sqrt(n * m / F.when(n + m > 0, n + m)) * d
    term = lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    return F.when(t < 0.2, 1.0).when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _poly(coefficients: list[float], x: float) -> float:
    out = 0.0
    for c in reversed(coefficients):
        out = out * x + c
    return out


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_p(values: np.ndarray) -> float:
    """p-value of the Shapiro-Wilk W (Royston 1995); NaN below 8 values or without spread."""
    x = np.sort(values[np.isfinite(values)])
    n = len(x)
    if n < 8 or x.var() <= 1e-16 or x[-1] - x[0] < 1e-19:
        return float("nan")
    m = np.array([_normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, u = float((m**2).sum()), 1 / math.sqrt(n)
    c = m / math.sqrt(ssq)
    a = np.empty(n)
    # Royston's polynomials of the two outer weights
    a[-1] = c[-1] + _poly([0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
    a[-2] = c[-2] + _poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
    phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / math.sqrt(phi)
    a[0], a[1] = -a[-1], -a[-2]
    w = min(1.0, float((a * x).sum() ** 2 / ((x - x.mean()) ** 2).sum()))
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    # Royston's normalising polynomials for small and large n
    if n <= 11:
        gamma = _poly([-2.273, 0.459], n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu, sigma = _poly([0.5440, -0.39978, 0.025054, -6.714e-4], n), math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    else:
        ln = math.log(n)
        mu, sigma = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln), math.exp(_poly([-0.4803, -0.082676, 0.0030302], ln))
    return 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


@pandas_udf(DoubleType())
def shapiro_p_of(values: pd.Series) -> pd.Series:
    """Shapiro-Wilk p-value of each array."""
    out = [shapiro_p(np.array([v for v in x if v is not None], dtype=float)) if x is not None else None for x in values]
    return pd.Series(out, dtype=float)
