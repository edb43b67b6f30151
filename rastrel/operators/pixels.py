"""Point operations on samples: levels, tables, polynomials, gains. All are projections; tables are constants or small joins.

Dither is a column expression too: noise() jumps to a sample's place in its row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 65535


def clamped(v: Column, bits: int = 16) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << bits) - 1).cast("long"), v))


def multiplier(black: Column, white: Column) -> Column:
    """16384 * 65535 over the span of levels, in single precision and cut to a whole number."""
    return (F.lit(16384.0 * 65535.0) / (white - black)).cast("float").cast("int").cast("long")


def scaled_u16(v: Column, black: Column, white: Column) -> Column:
    """v with black at 0 and white at 65535, in fixed point."""
    return clamped(F.shiftright((v - black) * multiplier(black, white) + 8192, 14))


def scaled_f32(v: Column, black: Column, white: Column) -> Column:
    return ((v - black) * F.lit(TOP) / (white - black)).cast("float")


def cell(x: Column, y: Column) -> Column:
    """Which of the four places of a 2 x 2 pattern."""
    return (y.bitwiseAND(F.lit(1)) * 2 + x.bitwiseAND(F.lit(1))).cast("int")


def scale_by_cell(df: DataFrame, black: list[int], white: int, crop_x: int = 0, crop_y: int = 0) -> DataFrame:
    """df with v scaled by the black level of its place in the full frame, of which the crop's origin decides the parity."""
    b = F.get(F.array(*[F.lit(n).cast("long") for n in black]), cell(F.col("x") + crop_x, F.col("y") + crop_y))
    no_op = not any(black) and white == TOP
    return df if no_op else df.withColumn("v", scaled_u16(F.col("v"), b, F.lit(white)))


def estimated_levels(df: DataFrame, width: int, height: int, inset: int, doubled_left: bool = True, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Least and greatest samples inside a border; on the left the border counts twice where the reading starts from it twice."""
    left = 2 * inset if doubled_left else inset
    area = (F.col("y") >= inset) & (F.col("y") < height - inset) & (F.col("x") >= left) & (F.col("x") < width)
    return df.filter(area).groupBy(*keys).agg(F.min("v").alias("black"), F.max("v").alias("white"))


def table_column(table: list[int]) -> Column:
    """A constant table, parsed once."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def looked_up(v: Column, table: list[int]) -> Column:
    """table[v], the last entry beyond its end."""
    return F.get(table_column(table), F.least(v, F.lit(len(table) - 1)).cast("int"))


def dither_table(curve: DataFrame) -> DataFrame:
    """(i, base, delta) of a curve (i, c): what dither spreads between a value's neighbours."""
    w = Window.orderBy("i")
    low = F.least(F.coalesce(F.lag("c").over(w), F.col("c")), F.col("c"))
    high = F.greatest(F.coalesce(F.lead("c").over(w), F.col("c")), F.col("c"))
    span = high - low
    return curve.select("i", clamped(F.col("c") - F.floor((span + 2) / 4)).alias("base"), span.alias("delta"))


def noise(seed: Column, x: Column, factor: int, width: int) -> Column:
    """The state after x + 1 steps of the multiply-with-carry generator whose step is low * factor + high of 16 bits each.

    Two steps bring any seed of 32 bits into its cycle, where a step is a multiplication by `factor` modulo
    factor * 2**16 - 1. So a sample's state needs none of those before it: only a power, from a table as long as the row.
    """
    step = lambda r: r.bitwiseAND(F.lit(65535)) * factor + F.shiftright(r, 16)
    modulus = (factor << 16) - 1
    one = step(seed.cast("long"))
    two = step(one)
    power = F.get(table_column([pow(factor, k, modulus) for k in range(max(1, width - 1))]), (x - 1).cast("int"))
    return F.when(x == 0, one).when(two == modulus, two).otherwise(F.pmod(two * power, F.lit(modulus)))


def dithered(base: Column, delta: Column, x: Column, y: Column, width: int) -> Column:
    """A value between base and its neighbours' distance delta, by noise whose seed depends on the row alone."""
    seed = ((F.lit(width) + y * 13).cast("long")).bitwiseXOR(F.lit(0x45694584).cast("long"))
    return base + F.shiftright(delta * noise(seed, x, 15700, width).bitwiseAND(F.lit(2047)) + 1024, 12)


def scale_dithered(df: DataFrame, width: int, black: list[int], white: int) -> DataFrame:
    """df with v scaled as by scale_by_cell() and dithered, by noise whose seed depends on the row alone."""
    span = 65535.0 / (white - black[0])
    full, half = int(np.float32(span) * np.float32(4)), int(np.float32(span) * np.float32(4095))
    b = F.get(F.array(*[F.lit(n).cast("long") for n in black]), cell(F.col("x"), F.col("y")))
    r = noise(F.lit(width) + F.col("y") * 36969, F.col("x"), 18000, width).bitwiseAND(F.lit(2047))
    return df.withColumn("v", clamped(F.shiftright((F.col("v") - b) * multiplier(b, F.lit(white)) + 8192 + F.lit(half).cast("long") - r * full, 14)))


def polynomial(v: Column, coefficients: list[float]) -> Column:
    """The polynomial of v / 65536, at the scale of 16 bits and cut to a whole number."""
    x = v.cast("double") / 65536
    y: Column = F.lit(0.0)
    for c in reversed(coefficients):
        y = y * x + F.lit(float(c))
    return clamped((y * 65535.5).cast("long"))


def in_roi(top: int, left: int, bottom: int, right: int, row_pitch: int = 1, col_pitch: int = 1) -> Column:
    x, y = F.col("x"), F.col("y")
    return (y >= top) & (y < bottom) & (x >= left) & (x < right) & (F.pmod(y - top, F.lit(row_pitch)) == 0) & (F.pmod(x - left, F.lit(col_pitch)) == 0)


def mapped(df: DataFrame, roi: Column, value: Column) -> DataFrame:
    return df.withColumn("v", F.when(roi, value).otherwise(F.col("v")))


def offset_u16(v: Column, f: Column) -> Column:
    """v plus a share f (from -1 to 1) of the full scale."""
    return clamped((F.lit(65535.0).cast("float") * f.cast("float")).cast("float").cast("long") + v)


def gain_u16(v: Column, f: Column) -> Column:
    return clamped(F.shiftright((F.lit(1024.0).cast("float") * f.cast("float")).cast("float").cast("long") * v + 512, 10))


def by_line(df: DataFrame, axis: str, factors: DataFrame, first: int = 0, pitch: int = 1) -> DataFrame:
    """df with `f`, the factor (i, f) of its row or column; null beyond."""
    at = F.floor((F.col(axis) - first) / pitch)
    return df.withColumn("_i", at).join(factors.withColumnRenamed("i", "_i"), "_i", "left").drop("_i")


def bilinear(x: Column, y: Column, grid: list[list[float]], step_x: int, step_y: int) -> Column:
    """A gain between the four corners of a grid's cell."""
    flat = F.array(*[F.lit(float(g)) for row in grid for g in row])
    across = len(grid[0])
    cx, cy = F.least(F.floor(x / step_x), F.lit(across - 2)), F.least(F.floor(y / step_y), F.lit(len(grid) - 2))
    fx, fy = (x - cx * step_x) / F.lit(float(step_x)), (y - cy * step_y) / F.lit(float(step_y))
    at = lambda dy, dx: F.get(flat, ((cy + dy) * across + cx + dx).cast("int"))
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def low_bits_merged(v: Column, low: Column, narrow: bool = False) -> Column:
    """Two more low bits; narrow sensors lift dark values by two."""
    out = F.shiftleft(v, 2).bitwiseOR(low)
    return F.when(F.lit(narrow) & (out < 512), out + 2).otherwise(out)


def red_blue_swapped(df: DataFrame) -> DataFrame:
    """df with the off-diagonal samples of each 2 x 2 swapped."""
    x, y = F.col("x"), F.col("y")
    odd = F.pmod(x + y, F.lit(2)) == 1
    left = F.pmod(x, F.lit(2)) == 1
    return df.withColumns({"x": F.when(odd, F.when(left, x - 1).otherwise(x + 1)).otherwise(x), "y": F.when(odd, F.when(left, y + 1).otherwise(y - 1)).otherwise(y)})


#: Fixed values, by version: what is added to luma, and in 4096ths the parts of both chroma in red, green and blue.
YUV = {
    0: (-512, ((0, 4096), (-778, -2048), (4096, 0))),
    1: (0, ((50, 22929), (-5640, -11751), (29040, -101))),
    2: (0, ((0, 4096), (-778, -2048), (4096, 0))),
}


def yuv_to_rgb(version: int, y: Column, cb: Column, cr: Column, gains: tuple[int, int, int]) -> list[Column]:
    """Red, green and blue by integer arithmetic, each with its gain in 256ths."""
    shift, rows = YUV[version]
    return [clamped(F.shiftright((y + F.shiftright(cb * b + cr * r, 12) + shift) * g, 8)) for g, (b, r) in zip(gains, rows, strict=True)]


def halfway_chroma(df: DataFrame, keys: list[str], along: str, value: str) -> DataFrame:
    """df, samples at even places only, with `<value>_next`: chroma halfway to the next place (whole numbers, cut), the last as it is."""
    following = F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(along)), F.col(value))
    return df.withColumn(f"{value}_next", F.shiftright(F.col(value) + following, 1))


#: How luma and both chroma, around their midpoint, make red, green and blue.
SNEF = (1.370705, (-0.337633, -0.698001), 1.732446)


def snef_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Red, green and blue of 12-bit luma and chroma, cut to 12 bits."""
    b, r = cb - 2048, cr - 2048
    return [clamped(v.cast("long"), 12) for v in (y + r * SNEF[0], y + b * SNEF[1][0] + r * SNEF[1][1], y + b * SNEF[2])]
