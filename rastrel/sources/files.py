"""Whole files, the XML catalog, and headerless rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = (1 << 32) - 1


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content, error): files with their bytes; oversized ones have an error, empty ones no row. Content that isn't asked for is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return df.select("path", "length", "content", F.when(F.col("length") > MOST_BYTES, "the file is too large").alias("error"))


def _attribute(name: str, kind: T.DataType | None = None) -> T.StructField:
    return T.StructField(f"_{name}", kind or T.StringType())


def _value(*attributes: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("_VALUE", T.StringType()), *attributes])


INT = T.IntegerType()
CAMERA = T.StructType([
    _attribute("make"), _attribute("model"), _attribute("mode"), _attribute("supported"), _attribute("decoder_version", INT),
    T.StructField("ID", _value(_attribute("make"), _attribute("model"))),
    T.StructField("CFA", T.StructType([_attribute("width", INT), _attribute("height", INT), T.StructField("Color", T.ArrayType(_value(_attribute("x", INT), _attribute("y", INT))))])),
    T.StructField("CFA2", T.StructType([_attribute("width", INT), _attribute("height", INT), T.StructField("ColorRow", T.ArrayType(_value(_attribute("y", INT))))])),
    T.StructField("Crop", T.StructType([_attribute(n, INT) for n in ("x", "y", "width", "height")])),
    T.StructField("Sensor", T.ArrayType(T.StructType([_attribute("black", INT), _attribute("white", INT), _attribute("iso_min", INT), _attribute("iso_max", INT), _attribute("iso_list"), _attribute("black_colors")]))),
    T.StructField("BlackAreas", T.StructType([T.StructField(n, T.ArrayType(T.StructType([_attribute(a, INT) for a in ("x", "y", "width", "height")]))) for n in ("Vertical", "Horizontal")])),
    T.StructField("Aliases", T.StructType([T.StructField("Alias", T.ArrayType(_value(_attribute("id"))))])),
    T.StructField("Hints", T.StructType([T.StructField("Hint", T.ArrayType(T.StructType([_attribute("name"), _attribute("value")])))])),
    T.StructField("ColorMatrices", T.StructType([T.StructField("ColorMatrix", T.ArrayType(T.StructType([T.StructField("ColorMatrixRow", T.ArrayType(_value(_attribute("plane", INT))))])))])),
])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of an XML catalog, one row for each name: the model's own first, then each alias in its place. Names of hints come first-wins."""
    cams = spark.read.format("xml").option("rowTag", "Camera").option("mode", "PERMISSIVE").schema(CAMERA).load(path)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cams = cams.select(
        text("_make").alias("make"), text("_model").alias("model"), text("_mode").alias("mode"), text("_supported").alias("status"), F.coalesce("_decoder_version", F.lit(0)).alias("decoder_version"),
        F.coalesce("ID._make", "_make").alias("canonical_make"), F.coalesce("ID._model", "_model").alias("canonical_model"), F.coalesce("ID._VALUE", F.concat_ws(" ", "_make", "_model")).alias("canonical_id"),
        F.col("Crop").alias("crop"), F.col("Sensor").alias("sensors"), F.coalesce("Aliases.Alias", F.array().cast(CAMERA["Aliases"].dataType["Alias"].dataType)).alias("_aliases"),
        F.map_from_entries(F.transform(_first_names("Hints.Hint"), lambda h: F.struct(h["_name"], h["_value"]))).alias("hints"),
        F.col("CFA2.ColorRow").alias("color_rows"), F.col("CFA.Color").alias("colors"), F.col("ColorMatrices.ColorMatrix").alias("matrices"), F.col("BlackAreas").alias("black_areas"),
    )
    names = F.concat(F.array(F.struct(F.col("model").alias("name"), F.col("model").alias("alias"))), F.transform("_aliases", lambda a: F.struct(a["_VALUE"].alias("name"), F.coalesce(a["_id"], a["_VALUE"]).alias("alias"))))
    out = cams.select("*", F.posexplode(names).alias("alias_no", "_n"))
    return out.select("make", F.col("_n.name").alias("model"), "mode", F.col("_n.alias").alias("canonical_alias"), "alias_no", *[c for c in cams.columns if c not in ("make", "model", "mode", "_aliases")])


def _first_names(column: str):
    hints = F.coalesce(F.col(column), F.array().cast(CAMERA["Hints"].dataType["Hint"].dataType))
    return F.filter(hints, lambda h, i: ~F.exists(F.slice(hints, F.lit(1), i), lambda other: other["_name"] == h["_name"]))


def headerless(files: DataFrame, cameras: DataFrame) -> DataFrame:
    """files (length, ...) with the geometry that the hints of a camera of this file size give; those without one are left out."""
    from ..operators.catalog import hint

    number = lambda name, default=None: hint("hints", name, "bigint", default)
    cams = cameras.select("make", "model", "mode", number("filesize").alias("_size"), number("full_width").alias("width"), number("full_height").alias("height"), number("offset", 0).alias("offset"), number("bits").alias("_bits"), hint("hints", "order", "string", "plain").alias("_order"))
    cams = cams.filter("_size IS NOT NULL AND width > 0 AND height > 0")
    bits = F.coalesce(F.when(F.col("_bits") > 0, F.col("_bits")), F.floor((F.col("_size") - F.col("offset")) * 8 / F.col("width") / F.col("height")))
    orders = F.create_map(*[F.lit(x) for x in ("plain", "lsb", "jpeg", "msb", "jpeg16", "msb16", "jpeg32", "msb32")])
    cams = cams.withColumns({"bits": bits, "order": F.try_element_at(orders, F.col("_order"))})
    return files.join(cams, files["length"] == cams["_size"]).drop("_size", "_bits", "_order")
