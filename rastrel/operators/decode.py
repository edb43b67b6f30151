"""Whole files as one plan: bytes, tag entries, geometry and storage, strips or tiles, samples, levels, crop.

Every step is a table: a file's directories become one row, its pieces are cut out of the bytes before they are rows, and
what can't be decoded is a row with an error. Python runs for the container and for compressed pieces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import number
from ..sources.containers import entries
from .pixels import cell, scaled_u16
from .tags import decoder
from .tiles import decoded_tiles

#: Tags that say where samples are, and what they mean.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "rows_per_strip": 278, "tile_width": 322, "tile_height": 323, "white": 50717, "dng": 50706,
}
LISTS = {"strip_offsets": 273, "strip_sizes": 279, "tile_offsets": 324, "tile_sizes": 325, "black": 50714, "crop_origin": 50719, "crop_size": 50720}
#: Which decoders take levels and crops from these tags; for others they mean nothing.
LEVELS = {"white": ("DNG",), "black": ("DNG", "3FR"), "crop_origin": ("DNG",), "crop_size": ("DNG",)}
TEXTS = {"make": 271, "model": 272, "software": 305}
#: Pieces that a file may have.
MOST_PIECES = 1 << 16


def numbers(value: Column, kind: Column, count: Column, big: Column) -> Column:
    """All numbers of an entry of two or four bytes each."""
    each = lambda size, order: F.transform(F.sequence(F.lit(0), F.greatest(count.cast("int"), F.lit(1)) - 1), lambda i: number(value, i * size, size, order))
    of = lambda size: F.when(big, each(size, True)).otherwise(each(size, False))
    return F.when(kind == 3, of(2)).when(kind.isin(4, 13), of(4))


def described(files: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """One row for each file: its largest image's geometry and storage, levels, names and decoder, or an error. A file that no decoder takes is an error, and has no samples."""
    e = entries(files, id_col, content)
    tag = F.col("tag")
    one = [F.first(F.when(tag == t, F.col("number")), ignorenulls=True).alias(n) for n, t in TAGS.items() if n != "dng"]
    many = [F.first(F.when(tag == t, numbers(F.col("value"), F.col("kind"), F.col("count"), F.col("big"))), ignorenulls=True).alias(n) for n, t in LISTS.items()]
    text = [F.first(F.when(tag == t, F.split_part(F.col("value").cast("string"), F.lit("\x00"), F.lit(1))), ignorenulls=True).alias(n) for n, t in TEXTS.items()]
    images = e.groupBy("file_id", "ifd").agg(*one, *many, *text, F.max(tag == TAGS["dng"]).alias("dng"), F.max("error").alias("error"))
    has = F.col("strip_offsets").isNotNull() | F.col("tile_offsets").isNotNull()
    kept = [c for c in images.columns if c not in ("file_id", "ifd", "error", "dng", *TEXTS)]
    best = F.max_by(F.struct(*kept), F.when(has, F.col("width") * F.col("height")))
    out = images.groupBy("file_id").agg(best.alias("image"), F.max("error").alias("error"), F.coalesce(F.max("dng"), F.lit(False)).alias("dng"), *[F.first(n, ignorenulls=True).alias(n) for n in TEXTS])
    name = decoder(F.col("make"), F.col("model"), F.col("dng"), F.lit(False), F.col("software"))
    own = [F.when(name.isin(*LEVELS[c]), F.col("image")[c]).alias(c) if c in LEVELS else F.col("image")[c].alias(c) for c in kept]
    return out.select("file_id", *own, name.alias("decoder"), F.coalesce("error", F.when(F.col("image").isNull(), "no image"), F.when(name.isNull(), "no decoder")).alias("error"))


def piece_geometry(n: Column) -> dict[str, Column]:
    """Place and size of the n-th strip or tile."""
    tiled = F.col("tile_offsets").isNotNull()
    across = F.ceil(F.col("width") / F.col("tile_width"))
    rows = F.least(F.coalesce("rows_per_strip", "height"), F.col("height"))
    return {
        "left": F.when(tiled, F.pmod(n, across) * F.col("tile_width")).otherwise(0),
        "top": F.when(tiled, F.floor(n / across) * F.col("tile_height")).otherwise(n * rows),
        "piece_width": F.when(tiled, F.col("tile_width")).otherwise(F.col("width")),
        "piece_height": F.when(tiled, F.col("tile_height")).otherwise(F.least(rows, F.col("height") - n * rows)),
    }


def pieces(files: DataFrame, images: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """(unit_id, compression, data, width, height): every strip or tile, cut out of its file. A piece beyond the file's end is shorter, and fails when decoded."""
    at, size = F.coalesce("tile_offsets", "strip_offsets"), F.coalesce("tile_sizes", "strip_sizes")
    cut = F.transform(F.arrays_zip(at.alias("at"), size.alias("size")), lambda p: F.substring("content", (p["at"] + 1).cast("int"), p["size"].cast("int")))
    df = files.select(F.col(id_col).alias("file_id"), F.col(content).alias("content")).join(images.filter("error IS NULL"), "file_id")
    df = df.select("file_id", *[c for c in images.columns if c not in ("file_id", "error")], F.posexplode_outer(cut).alias("n", "data")).filter(F.col("n") < MOST_PIECES)
    g = piece_geometry(F.col("n"))
    return df.select((F.col("file_id") * MOST_PIECES + F.col("n")).alias("unit_id"), F.coalesce("compression", F.lit(1)).cast("int").alias("compression"), "data", g["piece_width"].cast("int").alias("width"), g["piece_height"].cast("int").alias("height"))


def samples(files: DataFrame, images: DataFrame) -> DataFrame:
    """(file_id, y, x, v, error): samples of all pieces in their places; a piece that can't be decoded is a row with an error."""
    lines = decoded_tiles(pieces(files, images))
    lines = lines.select(F.floor(F.col("unit_id") / MOST_PIECES).alias("file_id"), F.pmod("unit_id", F.lit(MOST_PIECES)).alias("n"), "y", "error", F.posexplode_outer("v").alias("x", "v"))
    g = piece_geometry(F.col("n"))
    placed = lines.join(images.drop("error"), "file_id")
    inside = F.col("v").isNull() | ((F.col("x") + g["left"] < F.col("width")) & (F.col("y") + g["top"] < F.col("height")))
    return placed.filter(inside).select("file_id", (F.col("y") + g["top"]).cast("long").alias("y"), (F.col("x") + g["left"]).cast("long").alias("x"), F.col("v").cast("long").alias("v"), "error")


def developed(samples: DataFrame, images: DataFrame) -> DataFrame:
    """(file_id, y, x, v): samples between black and white levels at the full scale of 16 bits, within the crop and counted from it."""
    own = images.select("file_id", "black", F.coalesce("white", F.shiftleft(F.lit(1).cast("long"), 16) - 1).alias("white"), "crop_origin", "crop_size", "width", "height")
    df = samples.filter("error IS NULL").join(own, "file_id")
    black = F.coalesce(F.get("black", F.when(F.size("black") == 4, cell(F.col("x"), F.col("y"))).otherwise(0)), F.lit(0))
    left, top = (F.coalesce(F.get("crop_origin", F.lit(i)), F.lit(0)) for i in (0, 1))
    wide, high = (F.coalesce(F.get("crop_size", F.lit(i)), F.col(n)) for i, n in ((0, "width"), (1, "height")))
    x, y = F.col("x") - left, F.col("y") - top
    df = df.filter((x >= 0) & (y >= 0) & (x < wide) & (y < high))
    return df.select("file_id", y.alias("y"), x.alias("x"), scaled_u16(F.col("v"), black, F.col("white")).alias("v"))


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, samples) of files (file_id, content): what described() says, and the developed samples."""
    images = described(files)
    return images, developed(samples(files, images), images)
