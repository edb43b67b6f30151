"""Queries that encode images with a codec and decode them again: what comes out is what went in."""

import numpy as np
from pyspark.sql import functions as F

from ..operators.codecs import adaptive, decoded, in_words, planes, predictive, prefix
from ..registry import query
from . import fixtures as X

COUNTS, VALUES = prefix.flat_code(list(range(17)))
CODE = {"counts": COUNTS, "values": VALUES}


def encoded(df, encode, width, height):
    """(unit_id, data, width, height) of images (image_id, y, x, v); rows that an image lacks at its end are zero."""
    rows = df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s")).select("image_id", F.transform("s", lambda s: s["v"].cast("double")).alias("v"))

    def made(batches):
        import pyarrow as pa

        for b in batches:
            images = [np.array(v.as_py()).reshape(-1, width) for v in b.column(1)]
            data = [encode(np.pad(i, ((0, height - len(i)), (0, 0)))) for i in images]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["unit_id", "data"])

    return rows.mapInArrow(made, "unit_id long, data binary").withColumns({"width": F.lit(width), "height": F.lit(height)})


def round_trip(df, encode, codec, width=X.WIDTH, height=X.HEIGHT, **parameters):
    units = encoded(df, encode, width, height)
    return samples(decoded(units, codec, **parameters))


def round_trip_of_words(df, encode, codec, width=X.WIDTH, height=X.HEIGHT, **parameters):
    """As round_trip(), for samples of any size and codecs of 16 bits: what lies beyond is encoded as planes of its own."""
    units = encoded(df, lambda img: in_words(img, encode), width, height)
    return samples(decoded(units, codec, words=True, **parameters))


def samples(lines):
    out = lines.select("unit_id", "y", F.posexplode("v").alias("x", "v"))
    return out.select(F.col("unit_id").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def smooth(spark, sf_dir):
    """Samples of 12 bits, for codecs that allow no more."""
    return X.plane_u16(spark, sf_dir).withColumn("v", F.expr("v % 4096"))


PLANE, SMOOTH = f"WITH {X.plane_sql()} SELECT image_id, y, x, v FROM plane", f"WITH {X.plane_sql()} SELECT image_id, y, x, v % 4096 AS v FROM plane"


def _whole(f, **kw):
    return lambda img: f(img.astype(np.int64), **kw)


@query(PLANE)
def cdc06_lossless_frames(spark, sf_dir):
    return round_trip_of_words(X.plane_u16(spark, sf_dir), _whole(predictive.encode_frame, parts=2, restart_rows=4, **CODE), "prefix_frames")


@query(PLANE)
def cdc08_paired_lengths(spark, sf_dir):
    return round_trip_of_words(X.plane_u16(spark, sf_dir), _whole(predictive.encode_pairs, **CODE), "paired_lengths", **CODE)


@query(SMOOTH)
def cdc10_two_lane_prefix(spark, sf_dir):
    return round_trip(smooth(spark, sf_dir), _whole(predictive.encode_rows, **CODE), "prefix_rows", **CODE)


@query(f"WITH {X.plane_sql()} SELECT image_id, y, x, v % 8192 AS v FROM plane")
def cdc11_gradient(spark, sf_dir):
    return round_trip(X.plane_u16(spark, sf_dir).withColumn("v", F.expr("v % 8192")), _whole(adaptive.encode_gradient), "gradient")


@query(SMOOTH)
def cdc17_fixed_table(spark, sf_dir):
    return round_trip(smooth(spark, sf_dir), _whole(predictive.encode_v1), "v1")


@query(SMOOTH)
def cdc19_columns(spark, sf_dir):
    return round_trip(smooth(spark, sf_dir), _whole(predictive.encode_columns), "columns")


@query(f"WITH {X.plane_sql(40)} SELECT image_id, y, x, v % 4096 AS v FROM plane")
def cdc23_segments(spark, sf_dir):
    df = X.plane_u16(spark, sf_dir, 40).withColumn("v", F.expr("v % 4096"))
    return round_trip(df, _whole(predictive.encode_segments), "length_nibbles", 40, 25)


def rows_as_units(df):
    """Each row of an image as a unit of its own."""
    return df.selectExpr(f"image_id * {X.HEIGHT} + y AS image_id", "0L AS y", "x", "v")


def rows_of_units(df):
    return df.selectExpr(f"image_id div {X.HEIGHT} AS image_id", f"image_id % {X.HEIGHT} AS y", "x", "v")


@query(PLANE)
def cdc24_strips(spark, sf_dir):
    df = rows_as_units(X.plane_u16(spark, sf_dir))
    return rows_of_units(round_trip_of_words(df, lambda img: predictive.encode_strip(img[0].astype(np.int64)), "adaptive_lengths", X.WIDTH, 1))


@query(SMOOTH)
def cdc16_groups(spark, sf_dir):
    """Rows are filled up to whole groups of 16."""
    units = encoded(rows_as_units(smooth(spark, sf_dir)), lambda img: adaptive.encode_groups(np.pad(img[0].astype(np.int64), (0, 14))), X.WIDTH, 1).withColumn("width", F.lit(64))
    return rows_of_units(samples(decoded(units, "group_lengths")).filter(F.col("x") < X.WIDTH))


@query(f"WITH {X.PLANE_F32} SELECT image_id, y, x, CAST(trunc(v::DOUBLE * 1000000) AS BIGINT) AS v FROM fplane")
def cdc25_float_planes(spark, sf_dir):
    df = X.plane_f32(spark, sf_dir)
    rows = X.table(spark, sf_dir, "embeddings").count()
    units = encoded(df, lambda img: planes.encode_planes(img.astype("f4"), predictor=34894), 64, 32)
    out = decoded(units, "float_planes", bits=32, predictor=34894).filter(F.col("unit_id") * 32 + F.col("y") < rows).select("unit_id", "y", F.posexplode("v").alias("x", "v"))
    return out.select(F.col("unit_id").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col("v") * F.lit(1000000.0)).cast("long").alias("v"))


BLOCK_CODE = prefix.flat_code([*range(16), 255])


@query(f"WITH {X.plane_sql(40)} SELECT image_id, y, x, v % 1024 AS v FROM plane")
def cdc22_blocks_of_runs(spark, sf_dir):
    """Images are filled up to whole blocks."""
    df = X.plane_u16(spark, sf_dir, 40).withColumn("v", F.expr("v % 1024"))
    return round_trip(df, _whole(adaptive.encode_blocks, first=BLOCK_CODE, rest=BLOCK_CODE), "run_blocks", 40, 32, first=BLOCK_CODE, rest=BLOCK_CODE).filter("y < 25")


@query(PLANE)
def cdc07_sliced_frames(spark, sf_dir):
    encode = _whole(predictive.encode_sliced, parts=2, frame_width=10, widths=[20, 20, 10], **CODE)
    return round_trip_of_words(X.plane_u16(spark, sf_dir), encode, "sliced_frames", widths=[20, 20, 10])


@query(f"WITH {X.plane_sql()} SELECT image_id, CASE WHEN image_id % 3 = 2 THEN NULL ELSE 20 END AS rows, CASE WHEN image_id % 3 = 2 THEN 'unknown compression 99' END AS error FROM plane GROUP BY image_id")
def cdc29_tiles_by_compression(spark, sf_dir):
    from ..operators.tiles import decoded_tiles

    units = encoded(X.plane_u16(spark, sf_dir), lambda img: img.astype("<u2").tobytes(), X.WIDTH, X.HEIGHT)
    frames = encoded(X.plane_u16(spark, sf_dir), _whole(predictive.encode_frame, parts=2, **CODE), X.WIDTH, X.HEIGHT)
    t = units.filter("unit_id % 3 <> 1").withColumn("compression", F.expr("IF(unit_id % 3 = 0, 1, 99)")).unionByName(frames.filter("unit_id % 3 = 1").withColumn("compression", F.lit(7)))
    return decoded_tiles(t).groupBy(F.col("unit_id").alias("image_id")).agg(F.max(F.col("y") + 1).alias("rows"), F.max("error").alias("error"))


@query(f"WITH {X.plane_sql()}, t AS (SELECT event_id, unnest(range(0, 9)) AS k FROM events) SELECT event_id AS id, list(CAST(xor(65 + k, (event_id % 256 + (event_id % 7) * ((k + 1) * 96 + k * (k + 1) // 2)) % 256) AS BIGINT) ORDER BY k) AS clear FROM t GROUP BY event_id")
def fn32_unscrambled_bytes(spark, sf_dir):
    from ..functions import keystreams

    t = X.table(spark, sf_dir, "events").select("event_id", F.encode(F.lit("ABCDEFGHI"), "UTF-8").alias("data"))
    return t.select(F.col("event_id").alias("id"), keystreams.unscrambled(F.col("data"), 9, F.expr("event_id % 7"), F.expr("event_id % 256")).alias("clear"))
