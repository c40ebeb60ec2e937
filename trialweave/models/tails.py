"""Tails of the chi-square and t distributions for whole degrees of freedom."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the quadrature, and the logarithm below its largest value at which an integrand is cut.
STEPS, NEGLIGIBLE = 512, 40.0
#: Terms of the power series below a half chi-square of 1.
SERIES = 30


def chi2_tail(x: float, df: int) -> float:
    """Finite sum: start from one or two degrees of freedom and go up in steps of two."""
    if df < 1:
        raise ValueError("degrees of freedom must be at least 1")
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        tail, done = math.erfc(math.sqrt(half)), 1
    else:
        tail, done = math.exp(-half), 2
    while done < df:
        tail += math.exp(done / 2 * math.log(half) - half - math.lgamma(done / 2 + 1))
        done += 2
    return min(tail, 1.0)


def chi2_tail_column(x: Column, df: Column) -> Column:
    """The same tail as a column, for any whole number of degrees of freedom.

    One degree: erfc as the mean of exp(-x / (2 sin(a) ** 2)) over a quarter turn, where equal steps converge
    exponentially, and by its power series near zero. The terms of the finite sum then follow from one another.
    """
    half, odd = x / 2, df % 2 == 1
    corners = F.lit(0.5) * F.exp(-half)  # the integrand is 0 at angle 0

    def corner(total: Column, k: Column) -> Column:
        sine = F.sin(k * F.lit(math.pi / 2 / STEPS))
        return total + F.exp(-half / (sine * sine))

    def power(state: Column, k: Column) -> Column:
        following = state["power"] * -half / k
        return F.struct(following.alias("power"), (state["total"] + following / (2 * k + 1)).alias("total"))

    far = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS - 1)), corners, corner) / STEPS
    unit = F.struct(F.lit(1.0).alias("power"), F.lit(1.0).alias("total"))
    near = 1 - 2 * F.sqrt(half / math.pi) * F.aggregate(F.sequence(F.lit(1), F.lit(SERIES)), unit, power, lambda s: s["total"])
    erfc = F.when(half < 1, near).otherwise(far)

    def term(state: Column, k: Column) -> Column:
        following = state["term"] * half / (k + F.when(odd, 0.5).otherwise(1.0))
        return F.struct(following.alias("term"), (state["total"] + state["term"]).alias("total"))

    first = F.when(odd, 2 * F.sqrt(half / math.pi) * F.exp(-half)).otherwise(half * F.exp(-half))
    count = F.floor((df - 1) / 2).cast("int")
    start = F.struct(first.alias("term"), F.when(odd, erfc).otherwise(F.exp(-half)).alias("total"))
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, term, lambda s: s["total"])
    return F.when(df >= 1, F.when(x <= 0, 1.0).otherwise(F.least(total, F.lit(1.0))))


def _cosine_power(sine2: Column, df: Column) -> Column:
    """Integral of cos(a) ** (df - 1) from the angle with this squared sine to a right angle, by Simpson's rule."""
    power = (df - 1).cast("double")
    fall = F.coalesce(F.try_divide(F.lit(2 * NEGLIGIBLE), power), F.lit(float("inf")))
    low = F.asin(F.sqrt(sine2))
    high = F.asin(F.sqrt(-F.expm1(F.log1p(-sine2) - fall)))
    width = (high - low) / STEPS

    def term(total: Column, k: Column) -> Column:
        share = F.when(k.isin(0, STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        sine = F.sin(low + width * k)
        at_end = F.when(power == 0, 1.0).otherwise(0.0)
        return total + share * F.coalesce(F.exp(power / 2 * F.log1p(-sine * sine)), at_end)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), term) * width / 3


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| > |t|): with t = sqrt(df) tan(a), the density is a power of cos(a). NULL without degrees of freedom."""
    sine2 = t * t / (df + t * t)
    return F.when(df > 0, _cosine_power(sine2, df) / _cosine_power(F.lit(0.0), df))
