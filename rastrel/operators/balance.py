"""White balance as files give it: one array of three coefficients (red, green, blue) out of a file's tag entries.

Each maker's rule is an expression over a map from tag to numbers; the first that finds what it needs wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that hold white balance.
NEUTRAL, WHITE_XY, LEVELS, RED, BLUE, UNCORRECTED, BLACKS = 50728, 50729, 0x0201, 0x1017, 0x1018, 0xA021, 0xA028
USED = (NEUTRAL, WHITE_XY, LEVELS, RED, BLUE, UNCORRECTED, BLACKS)
#: Green where a file gives red and blue alone.
GREEN = 256.0


def inverted(c: Column) -> Column:
    return F.when(c > 0, 1.0 / c).otherwise(0.0)


def from_neutral(neutral: Column) -> Column:
    """Of what a neutral surface looks like to the sensor."""
    return F.when(F.size(neutral) == 3, F.transform(neutral, inverted))


def from_white_point(xy: Column, matrix: Column) -> Column:
    """Of the light's chromaticity, seen through a matrix of three rows of three."""
    x, y = F.get(xy, F.lit(0)), F.get(xy, F.lit(1))
    light = (x / y, F.lit(1.0), (1 - x - y) / y)
    seen = [sum((F.get(matrix, F.lit(3 * i + k)) * light[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return F.when((F.size(xy) == 2) & (F.size(matrix) == 9) & (y > 0), F.array(*map(inverted, seen)))


def outer_and_first_green(levels: Column) -> Column:
    """Of four levels in the order of a 2 x 2 pattern the red one, the first green one and the blue one."""
    return F.when(F.size(levels) == 4, F.array(*[F.get(levels, F.lit(i)) for i in (0, 1, 3)]))


def white_balance(entries: DataFrame, matrix: Column | None = None) -> DataFrame:
    """(file_id, wb) of entries (file_id, tag, numbers: array<double>), one row for each file; null where no rule holds.

    A neutral colour excludes the white point even if it is not usable. matrix: by which white points are seen.
    """
    own = F.filter(F.collect_list(F.when(F.col("tag").isin(*USED), F.struct("tag", "numbers"))), lambda e: e.isNotNull())
    tags = entries.groupBy("file_id").agg(F.array_sort(own).alias("_tags"))
    of = lambda tag: F.get(F.filter("_tags", lambda e: e["tag"] == tag), F.lit(0))["numbers"]
    less = F.zip_with(of(UNCORRECTED), of(BLACKS), lambda a, b: a - b)
    pair = F.when(of(RED).isNotNull() & of(BLUE).isNotNull(), F.array(F.get(of(RED), F.lit(0)), F.lit(GREEN), F.get(of(BLUE), F.lit(0))))
    point = from_white_point(of(WHITE_XY), matrix) if matrix is not None else F.lit(None).cast("array<double>")
    rest = F.coalesce(point, outer_and_first_green(of(LEVELS)), F.when((F.size(of(UNCORRECTED)) == 4) & (F.size(of(BLACKS)) == 4), outer_and_first_green(less)), pair)
    return tags.select("file_id", F.when(of(NEUTRAL).isNotNull(), from_neutral(of(NEUTRAL))).otherwise(rest).alias("wb"))
