"""Discrete distributions as column expressions, for any counts and rates of a row.

A count is a whole number; masses outside of a distribution's range are 0, sums below it 0 and above it 1. Unknown inputs give
null. Probabilities are held within 1e-12 of 0 and 1. `ln_factorial` is exact to 1e-10 or better (a series above 20)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON, MOST = 1e-12, 745.0


def _held(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _p(p: Column) -> Column:
    return _held(p.cast("double"), EPSILON, 1 - EPSILON)


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive x: moved up by eight, then Stirling's series."""
    x = x.cast("double")
    y = x + 8
    below = sum((F.ln(x + k) for k in range(8)), F.lit(0.0))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def ln_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(21)])
    return F.when(n <= 20, F.get(table, n.cast("int"))).otherwise(ln_gamma(n + 1))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    p = _p(p)
    mass = F.exp(F.greatest(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.ln(p) + (n - k) * F.ln(1 - p), F.lit(-MOST)))
    return F.when((k < 0) | (n < 0) | (k > n), 0.0).otherwise(mass)


def _sum(mass, k: Column) -> Column:
    """The sum of masses from 0 to k, by the row's own counts."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")), F.lit(0.0), lambda s, i: s + mass(i))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(_held(_sum(lambda i: binomial_pmf(i, n, p), k), 0.0, 1.0))


def at_least_one(p: Column, opportunities: Column) -> Column:
    return 1 - F.pow(1 - _held(p.cast("double"), 0.0, 1.0), F.greatest(opportunities, F.lit(0)))


def poisson_pmf(k: Column, rate: Column) -> Column:
    rate = rate.cast("double")
    mass = F.exp(F.greatest(k * F.ln(rate) - rate - ln_factorial(k), F.lit(-MOST)))
    return F.when(k < 0, 0.0).when(rate <= EPSILON, (k == 0).cast("double")).otherwise(mass)


def poisson_cdf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(_held(_sum(lambda i: poisson_pmf(i, rate), k), 0.0, 1.0))


def negative_binomial_pmf(k: Column, mean: Column, dispersion: Column) -> Column:
    """Counts of a mean and a dispersion (smaller is wider)."""
    r = dispersion.cast("double")
    p = r / (r + mean)
    mass = F.exp(F.greatest(ln_gamma(k + r) - ln_gamma(r) - ln_factorial(k) + r * F.ln(p) + k * F.ln(1 - p), F.lit(-MOST)))
    return F.when((k < 0) | (mean < 0) | (r <= 0), 0.0).when(mean <= EPSILON, (k == 0).cast("double")).otherwise(mass)
