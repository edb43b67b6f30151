"""Curves over 16-bit samples, as short tables made on the driver or as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 65535


def spline(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(a, b, c, d) of the natural cubic spline between points: a + b t + c t^2 + d t^3 from each on. x runs from 0 to 65535 and rises."""
    x, y = (np.array(v, float) for v in zip(*points, strict=True))
    if x[0] != 0 or x[-1] != TOP or (np.diff(x) <= 0).any():
        raise ValueError("x must rise from 0 to 65535")
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    m = np.eye(n)
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 3 * (slope[i] - slope[i - 1])
    c = np.linalg.solve(m, rhs)
    b = slope - h * (2 * c[:-1] + c[1:]) / 3
    d = np.diff(c) / (3 * h)
    return [tuple(map(float, s)) for s in zip(y[:-1], b, c[:-1], d, strict=True)]


def spline_table(points: list[tuple[float, float]], whole: bool = True) -> np.ndarray:
    """The spline at 0..65535; whole: limited to 16 bits and cut."""
    x = np.array([p[0] for p in points])
    at = np.arange(TOP + 1)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(points) - 2)
    seg = np.array(spline(points))[k]
    t = at - x[k]
    v = seg[:, 0] + t * (seg[:, 1] + t * (seg[:, 2] + t * seg[:, 3]))
    return np.clip(v, 0, TOP).astype(np.int64) if whole else v


def spline_at(v: Column, points: list[tuple[float, float]]) -> Column:
    """The spline of a column, segment by segment, without a table."""
    out: Column = F.lit(None).cast("double")
    for (x, _), (a, b, c, d) in zip(points, spline(points), strict=False):
        t = v - x
        out = F.when(v >= x, F.lit(a) + t * (F.lit(b) + t * (F.lit(c) + t * F.lit(d)))).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(65535.0), out)).cast("long")


def power(v: Column, gamma: float) -> Column:
    return F.pow(v, F.lit(1 / gamma))


def gamma_table(power: float, slope: float, top: int) -> np.ndarray:
    """A power curve with a straight beginning of that slope; where both meet, they have one tangent. 65535 from `top` on."""
    lo, hi = (0.0, 1.0) if slope < 1 else (1.0, 0.0)
    join = off = 0.0
    if slope and (slope - 1) * (power - 1) <= 0:
        for _ in range(48):
            join = (lo + hi) / 2
            above = ((join / slope) ** -power - 1) / power - 1 / join > -1 if power else join / math.exp(1 - 1 / join) < slope
            lo, hi = (lo, join) if above else (join, hi)
        if power:
            off = join * (1 / power - 1)
    r = np.arange(TOP + 1) / top
    with np.errstate(all="ignore"):
        curved = ((r + off) / (1 + off)) ** (1 / power) if power else np.exp((r - 1) / join)
        v = np.where(r < join, r / slope if slope else 0, curved)
    return np.where(r >= 1, TOP, np.floor(65536 * np.nan_to_num(v))).astype(np.int64)


def log_table(bits: int = 16) -> np.ndarray:
    """The inverse of a logarithmic response: linear from 12-bit codes."""
    n = np.arange(1 << 12) / ((1 << 12) - 1)
    return (((1 << bits) - 1) * (113.0**n - 1) / 112.0).astype(np.int64)


def knee_table(knots: list[int]) -> np.ndarray:
    """A curve over 0..16384 that rises by 1, 2, 4, 8 and 16 between four 12-bit knots and the end of 12 bits, and is the identity behind."""
    ends = [0, *[k >> 2 & 0xFFF for k in knots], 4095]
    curve = np.arange(0x4001)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if b > a:
            curve[a + 1 : b + 1] = curve[a] + (1 << i) * np.arange(1, b - a + 1)
    return curve


def interpolated_table(knots: list[int], size: int) -> np.ndarray:
    """Straight lines between knots at equal steps, whole numbers cut; the last knot only ends the last line."""
    step = size // (len(knots) - 1)
    at = np.arange(size)
    k, b = at // step, at % step
    left, right = np.array(knots)[k], np.array(knots)[k + 1]
    return ((step - b) * left + b * right) // step


def decompanded(c: Column) -> Column:
    """A companded coefficient: its cube's share on top, within 16 bits."""
    size = F.abs(c).cast("double")
    v = F.floor(size + 768.0 * size * size * size / F.lit(255.0**3))
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.when(c < 0, -v).otherwise(v)))
