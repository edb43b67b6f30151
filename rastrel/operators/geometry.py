"""Areas, crops, tiles, slices and ranges. A crop is a filter and a shift of coordinates; nothing is copied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    x: int
    y: int
    w: int
    h: int

    @property
    def right(self) -> int:
        return self.x + self.w

    @property
    def bottom(self) -> int:
        return self.y + self.h

    def has_area(self) -> bool:
        return self.w > 0 and self.h > 0

    def overlap(self, other: Rect) -> Rect:
        """What both cover; without area if nothing."""
        x, y = max(self.x, other.x), max(self.y, other.y)
        return Rect(x, y, max(0, min(self.right, other.right) - x), max(0, min(self.bottom, other.bottom) - y))

    def contains(self, other: Rect) -> bool:
        return self.x <= other.x and self.y <= other.y and other.right <= self.right and other.bottom <= self.bottom


def relative_crop(x: int, y: int, w: int, h: int, full_w: int, full_h: int) -> Rect:
    """A crop whose size may be given from the far edge, as zero or less."""
    return Rect(x, y, w if w > 0 else full_w - x + w, h if h > 0 else full_h - y + h)


def contains(r: Rect, x: str = "x", y: str = "y", inclusive: bool = False) -> Column:
    """Whether a point is inside; inclusive: the far edges count."""
    a, b = F.col(x), F.col(y)
    far = (a <= r.right) & (b <= r.bottom) if inclusive else (a < r.right) & (b < r.bottom)
    return (a >= r.x) & (b >= r.y) & far


def inside(df: DataFrame, r: Rect) -> DataFrame:
    return df.filter(contains(r))


def sub_frame(df: DataFrame, r: Rect, width: int, height: int) -> DataFrame:
    """df cropped to r, its coordinates counted from there. An area larger than the frame or beyond its origin changes nothing; one without area is an error."""
    if not r.has_area():
        raise ValueError("no area to crop to")
    if r.x < 0 or r.y < 0 or not Rect(0, 0, width, height).contains(r):
        return df
    return inside(df, r).withColumns({"x": F.col("x") - r.x, "y": F.col("y") - r.y})


def cleared(df: DataFrame, r: Rect, width: int, height: int) -> DataFrame:
    """df with zeros in the area: from its left edge over as many columns as the frame is wide, in its rows."""
    a = r.overlap(Rect(0, 0, width, height))
    hit = (F.col("y") >= a.y) & (F.col("y") < a.bottom) & (F.col("x") >= a.x) & (F.col("x") < a.w) if a.has_area() else F.lit(False)
    return df.withColumn("v", F.when(hit, 0).otherwise(F.col("v")))


def range_contains(s: Column, e: Column, at: Column) -> Column:
    return (s <= at) & (at < e)


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Equal starts overlap even if a range is empty; else the earlier range holds the later start."""
    return (s1 == s2) | ((s1 < s2) & (s2 < e1)) | ((s2 < s1) & (s1 < e2))


def overlap_flags(df: DataFrame, group: str, s: str, e: str, order: str) -> DataFrame:
    """df with `clash`: whether a range overlaps one before it by (start, end, order). One sort; no pairs."""
    w = Window.partitionBy(group).orderBy(s, e, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("clash", F.coalesce((F.max(e).over(before) > F.col(s)) | (F.lag(s).over(w) == F.col(s)), F.lit(False)))


def tiles(width: int, height: int, tile_w: int, tile_h: int, n: Column) -> dict[str, Column]:
    """Place and size of the n-th tile, row by row; tiles at the far edges are cut."""
    across = -(-width // tile_w)
    col, row = F.pmod(n, F.lit(across)), F.floor(n / across)
    x, y = col * tile_w, row * tile_h
    return {"col": col, "row": row, "x": x, "y": y, "w": F.least(F.lit(tile_w), width - x), "h": F.least(F.lit(tile_h), height - y)}


def slices(k: Column, widths: list[int], height: int) -> dict[str, Column]:
    """(x, y) of the k-th sample where vertical slices of these widths are stored one after the other, each row by row."""
    x: Column = F.lit(None).cast("long")
    y: Column = F.lit(None).cast("long")
    left = 0
    for w in widths:
        at = k - left * height
        hit = (at >= 0) & (at < w * height)
        x = F.when(hit, left + F.pmod(at, F.lit(w))).otherwise(x)
        y = F.when(hit, F.floor(at / w)).otherwise(y)
        left += w
    return {"x": x, "y": y}


def rotated45(df: DataFrame, crop_w: int, alternate: bool = False) -> DataFrame:
    """df with samples of a diagonal layout at the places of the upright, larger frame."""
    x, y = F.col("x"), F.col("y")
    if alternate:
        h, w = crop_w - 1 - y + F.shiftright(x, 1), F.shiftright(x + 1, 1) + y
    else:
        h, w = crop_w - 1 - x + F.shiftright(y, 1), F.shiftright(y + 1, 1) + x
    return df.withColumns({"x": w, "y": h})


def strips_by_offset(df: DataFrame, file: str = "file_id", off: str = "off") -> DataFrame:
    """df with `size`: bytes up to the next strip by offset (null for the last) and `bad`: an offset that comes twice."""
    w = Window.partitionBy(file).orderBy(off)
    return df.withColumns({"size": F.lead(off).over(w) - F.col(off), "bad": F.coalesce(F.lag(off).over(w) == F.col(off), F.lit(False))})


def strips_as_stored(df: DataFrame, file: str = "file_id", n: str = "n", off: str = "off") -> DataFrame:
    """df with `size` by the next stored strip, and `bad` where that doesn't lie behind."""
    following = F.lead(off).over(Window.partitionBy(file).orderBy(n))
    return df.withColumns({"size": following - F.col(off), "bad": F.coalesce(following <= F.col(off), F.lit(False))})


def dense(df: DataFrame, group: str, n: str) -> DataFrame:
    """df with `in_place`: whether n is its place in order, from 0."""
    w = Window.partitionBy(group).orderBy(n)
    return df.withColumn("in_place", F.row_number().over(w) - 1 == F.col(n))


def coalesced(df: DataFrame, file: str = "file_id", off: str = "off", length: str = "len") -> DataFrame:
    """For each file the span of its slices, the padding between them, and whether any overlap."""
    w = Window.partitionBy(file).orderBy(off, length)
    gap = F.col(off) - F.lag(F.col(off) + F.col(length)).over(w)
    return df.withColumn("_gap", gap).groupBy(file).agg(
        F.min(off).alias("begin"), (F.max(F.col(off) + F.col(length)) - F.min(off)).alias("span"), F.sum(F.greatest("_gap", F.lit(0))).alias("padding"), F.coalesce(F.bool_or(F.col("_gap") < 0), F.lit(False)).alias("overlap")
    )


def strictly_increasing(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """For each group, whether values rise from each row to the next."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_d", step).groupBy(group).agg(F.coalesce(F.min("_d") > 0, F.lit(True)).alias("rising"))


def points(rects: DataFrame) -> DataFrame:
    """The points of rectangles (x, y, w, h), one row each."""
    across = rects.select(*[c for c in rects.columns if c not in "xywh"], "y", "h", F.explode(F.sequence("x", F.col("x") + F.col("w") - 1)).alias("px"))
    return across.select(*[c for c in across.columns if c not in ("y", "h")], F.explode(F.sequence("y", F.col("y") + F.col("h") - 1)).alias("py"))
