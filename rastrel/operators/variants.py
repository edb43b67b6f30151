"""Small decisions between variants of a format, and levels by precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arw_variant(count: Column, width: Column, height: Column, bits: Column, second_make: Column) -> dict[str, Column]:
    """The older variant's byte count doesn't fit its samples; it then has eight more rows. A second maker entry means eight bits."""
    arw1 = count * 8 != width * height * bits
    return {"arw1": arw1, "height": F.when(arw1, height + 8).otherwise(height), "bits": F.when(second_make, 8).otherwise(bits)}


def shifted_levels(black: Column, white: Column, down: int = 0, up: int = 0) -> dict[str, Column]:
    """Levels at a lower precision; or at a higher one, where black starts anew at 0."""
    if up:
        return {"black": F.lit(0).cast("long"), "white": F.shiftleft(white, up)}
    return {"black": F.shiftright(black, down), "white": F.shiftright(white, down)}
