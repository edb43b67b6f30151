"""Narrow floating-point numbers from their bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widened(v: Column, exponent: int, fraction: int) -> Column:
    """The double of a sign, an exponent and a fraction of so many bits; subnormal ones are kept, the top exponent gives infinity or NaN."""
    one = lambda n: F.lit((1 << n) - 1).cast("long")
    v = v.cast("long")
    s = F.shiftright(v, exponent + fraction).bitwiseAND(F.lit(1))
    e = F.shiftright(v, fraction).bitwiseAND(one(exponent))
    f = v.bitwiseAND(one(fraction)).cast("double")
    bias, top = (1 << exponent - 1) - 1, (1 << exponent) - 1
    sign = F.when(s == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = F.pow(F.lit(2.0), (e - bias).cast("double")) * (f / F.lit(float(1 << fraction)) + 1)
    small = f * F.lit(2.0 ** (1 - bias - fraction))
    return F.when(e == top, F.when(f == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(sign * F.when(e == 0, small).otherwise(normal))


def half(v: Column) -> Column:
    return widened(v, 5, 10)


def three_bytes(v: Column) -> Column:
    return widened(v, 7, 16)


def single(v: Column) -> Column:
    return widened(v, 8, 23)


def rational(num: Column, den: Column) -> Column:
    """Zero over nothing."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)
