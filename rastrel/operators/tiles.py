"""Tiles of an image: which codec each needs, decoding by codec, and assembly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels
from .codecs import decoded

#: Compression numbers of tiles, codec and how it is called.
COMPRESSIONS = {1: "uncompressed", 7: "prefix_frames", 8: "float_planes"}


@dataclass(frozen=True)
class Options:
    """What a host may ask of decoding."""

    fail_on_unknown: bool = False
    repair: bool = True
    crop: bool = True
    uncorrected: bool = False
    rotate: bool = True
    quadrants: bool = True

    def curved(self, v: Column, table: list[int]) -> Column:
        """v by a curve, or as it is where raw values are wanted."""
        return v if self.uncorrected else pixels.looked_up(v, table)


def bit_order(bits: Column, big: Column) -> Column:
    """Order of plain samples: high bits first for odd widths, whatever the file's byte order."""
    return F.when(~bits.isin(8, 16, 32), "msb").otherwise(F.when(big, "msb").otherwise("lsb"))


def decoded_tiles(tiles: DataFrame, parameters: dict[int, dict] | None = None) -> DataFrame:
    """(unit_id, y, v, error) of tiles (unit_id, compression, data, width, height): one pass for each codec; unknown ones give error rows."""
    own = parameters or {}
    known = [c for c, name in COMPRESSIONS.items() if name != "uncompressed"]
    parts = [decoded(tiles.filter(F.col("compression") == c), COMPRESSIONS[c], **own.get(c, {})) for c in known]
    plain = tiles.filter(F.col("compression") == 1)
    # a tile's rows are cut before they are rows of the table: else each would carry the whole tile
    wide = (F.col("width") * 2).cast("int")
    enough = F.length("data") >= F.col("height") * wide
    cut = F.transform(F.sequence(F.lit(0), F.col("height").cast("int") - 1), lambda y: F.hex(F.substring("data", y * wide + 1, wide)))
    rows = plain.select(F.col("unit_id").cast("long"), "width", enough.alias("enough"), F.posexplode_outer(F.when(enough, cut)).alias("y", "row"))
    row = F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda x: F.conv(F.concat(F.substring("row", x * 4 + 3, F.lit(2)), F.substring("row", x * 4 + 1, F.lit(2))), 16, 10).cast("double"))
    parts.append(rows.select("unit_id", F.col("y").cast("int").alias("y"), F.when(F.col("row").isNotNull(), row).alias("v"), F.when(F.col("row").isNull(), "not enough bytes").alias("error")))
    other = tiles.filter(~F.col("compression").isin(*COMPRESSIONS)).select(F.col("unit_id").cast("long"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("array<double>").alias("v"), F.concat(F.lit("unknown compression "), F.col("compression").cast("string")).alias("error"))
    return reduce(DataFrame.unionByName, [*parts, other])
