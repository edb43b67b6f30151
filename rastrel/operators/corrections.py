"""Corrections by region of the sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves


def by_quadrant(df: DataFrame, split_row: int, split_col: int, values: list[list[Column]]) -> DataFrame:
    """df with v by the expression of its quadrant: values[below][right]."""
    top, bottom = (F.when(F.col("x") < split_col, v[0]).otherwise(v[1]) for v in values)
    return df.withColumn("v", F.when(F.col("y") < split_row, top).otherwise(bottom))


def quadrant_curves(df: DataFrame, split_row: int, split_col: int, black: int, knots: list[int], gains: list[list[list[int]]]) -> DataFrame:
    """df with each quadrant's spline, through knots scaled by gains in ten-thousandths, applied above the black level."""

    def curve(g: list[int]) -> Column:
        points = [(0, 0), *[(x, x * n // 10000) for x, n in zip(knots, g, strict=True)], (65535, 65535)]
        return F.least(F.lit(65535), curves.spline_at(F.greatest(F.col("v") - black, F.lit(0)), points) + black)

    return by_quadrant(df, split_row, split_col, [[curve(g) for g in row] for row in gains])
