"""Scalar expressions on scores and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -35.0, 35.0)))


def finite(c: Column, missing: float = -999.0, bound: float = 1e9) -> Column:
    """Null and NaN become ``missing``; infinities become plus or minus ``bound``."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), missing).when(c == float("inf"), bound).when(c == float("-inf"), -bound).otherwise(c)


def to_number(c: Column) -> Column:
    """Text as a number; what is none becomes null."""
    return c.try_cast("double")


def binary_label(c: Column, ones: tuple[str, ...], zeros: tuple[str, ...]) -> Column:
    """Label text as 1, 0 or null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*ones), 1).when(low.isin(*zeros), 0)


def hinges(c: Column, knots: tuple[float, ...]) -> list[Column]:
    """The value and its excess over each knot: a piecewise-linear basis."""
    return [c, *(F.greatest(c - k, F.lit(0.0)) for k in knots)]


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a rational approximation (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def uniform(*parts: Column | str) -> Column:
    """A draw in [0, 1) set by the parts alone: 32 bits of their MD5."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
