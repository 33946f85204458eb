"""Propagation of standard uncertainties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import normal_cdf, ratio, uniform


def add(sa: Column, sb: Column, rho: float = 0.0, sign: int = 1) -> Column:
    """Of a + b, or of a - b with sign -1."""
    return F.sqrt(F.greatest(F.lit(0.0), sa * sa + sb * sb + sign * 2 * rho * sa * sb))


def multiply(a: Column, sa: Column, b: Column, sb: Column, rho: float = 0.0) -> Column:
    return F.abs(a * b) * _relative(a, sa, b, sb, rho)


def divide(a: Column, sa: Column, b: Column, sb: Column, rho: float = 0.0) -> Column:
    return F.when(F.abs(b) > 1e-10, F.abs(ratio(a, b, 1e-10)) * _relative(a, sa, b, sb, -rho))


def _relative(a, sa, b, sb, rho):
    ra, rb = ratio(sa, a, 1e-10, 0.0), ratio(sb, b, 1e-10, 0.0)
    return F.sqrt(F.greatest(F.lit(0.0), ra * ra + rb * rb + 2 * rho * ra * rb))


def power(x: Column, s: Column, n: float) -> Column:
    return F.when(F.abs(x) > 1e-10, F.abs(F.lit(n) * F.pow(x, n) / x) * s)


def function(x: Column, s: Column, f: Callable[[Column], Column], step: float = 1e-4) -> Column:
    """Of f(x), by the central difference of f."""
    return F.abs((f(x + step) - f(x - step)) / (2 * step)) * s


def root_sum_square(*s: Column) -> Column:
    out = F.lit(0.0)
    for x in s:
        out = out + x * x
    return F.sqrt(out)


def correlated(s: list[Column], rho: float) -> Column:
    """Of a sum whose terms have one correlation."""
    out = F.lit(0.0)
    for i, x in enumerate(s):
        for j, y in enumerate(s):
            out = out + (x * y if i == j else rho * x * y)
    return F.sqrt(F.greatest(F.lit(0.0), out))


def exceedance(x: Column, s: Column, threshold: float) -> Column:
    """P(value > threshold) under a normal error; certain where s is 0."""
    return F.when(s > 0, 1 - normal_cdf((threshold - x) / s)).when(x > threshold, 1.0).otherwise(0.0)


def interpolation(before: Column, after: Column, fraction: Column) -> Column:
    return 2 * F.abs(fraction - 0.5) * F.abs(after - before) * 0.5


def normal_draw(*keys: Column) -> Column:
    """A draw from the standard normal distribution that the keys alone decide (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(*keys, F.lit(1)))) * F.cos(2 * F.pi() * uniform(*keys, F.lit(2)))
