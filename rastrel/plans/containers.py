"""Queries on container files, which are made from the given tables."""

import struct

import numpy as np
from pyspark.sql import functions as F

from ..operators import decode
from ..operators.aggregates import digest
from ..registry import query
from ..sinks import images
from ..sources import containers as C
from . import fixtures as X


def number_entry(tag, v, e):
    """A whole number of 32 bits at most as an entry: two bytes where they hold it, else four."""
    return (tag, 3, 1, struct.pack(e + "H", v)) if v <= 0xFFFF else (tag, 4, 1, struct.pack(e + "I", v))


def files(spark, sf_dir):
    """Each event as a TIFF file of two directories."""

    def made(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, u, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                big = i % 20 == 0
                e = ">" if big else "<"
                first = [(256, 4, 1, struct.pack(e + "I", 100 + u)), number_entry(257, u, e), (271, 2, len(s) + 1, s.encode() + b"\0")]
                out.append(C.written_tiff([first, [(256, 4, 1, struct.pack(e + "I", i)), (256, 4, 1, struct.pack(e + "I", i + 1))]], big))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["file_id", "content"])

    rows = X.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.mapInArrow(made, "file_id long, content binary")


@query("""SELECT event_id AS file_id, '0.0' AS ifd, t AS tag, CASE t WHEN 256 THEN CAST(100 + user_id AS VARCHAR) WHEN 257 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS value FROM events, (SELECT unnest([256, 257, 271]) AS t)
UNION ALL SELECT event_id, '0.1', 256, CAST(event_id + 1 AS VARCHAR) FROM events""")
def src06_tiff_entries(spark, sf_dir):
    e = C.entries(files(spark, sf_dir))
    text = F.split_part(F.col("value").cast("string"), F.lit("\x00"), F.lit(1))
    return e.select("file_id", "ifd", "tag", F.when(F.col("kind") == 2, text).otherwise(F.col("number").cast("string")).alias("value"))


@query("SELECT event_id AS file_id, CAST(100 + user_id AS BIGINT) AS width FROM events")
def src06_first_width(spark, sf_dir):
    """The first entry of a tag in the walk, as a filter and a minimum over rows."""
    e = C.entries(files(spark, sf_dir)).filter("tag = 256")
    return e.groupBy("file_id").agg(F.min_by("number", "dfs").alias("width"))


@query("SELECT event_id AS file_id, 'make: ' || event_type || chr(10) || 'isoSpeed: ' || user_id || chr(10) || 'whitePoint: ' || CASE WHEN event_id % 3 = 0 THEN '(none)' ELSE CAST(event_id AS VARCHAR) END AS report FROM events")
def snk03_text_report(spark, sf_dir):
    white = F.expr("IF(event_id % 3 = 0, NULL, event_id)")
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), images.report({"make": F.col("event_type"), "isoSpeed": F.col("user_id"), "whitePoint": white}).alias("report"))


#: Of the made files: black levels by place, white level, origin and size of the crop.
BLACK, WHITE, CROP = (64, 96, 128, 160), 52000, (4, 2, 40, 16)


def raw_file(img, kind):
    """An image as a self-describing file: little-endian strips, big-endian tags with lossless tiles, or plain tiles that reach beyond the frame.

    Files have 16 bits a sample, so what lies beyond is saturated, as in a sensor: that is above WHITE or below BLACK, where levels end anyway.
    """
    from ..operators.codecs import predictive, prefix

    img = np.clip(img, 0, 0xFFFF)
    height, width = img.shape
    big = kind == 1
    e = ">" if big else "<"
    counts, values = prefix.flat_code(list(range(17)))
    if kind == 0:
        data = [img[y : y + 6].astype("<u2").tobytes() for y in range(0, height, 6)]
        layout, offsets, sizes = [(278, 3, (6,))], 273, 279
    else:
        wide, high = (26, 12) if kind == 1 else (16, 16)
        padded = np.pad(img, ((0, -height % high), (0, -width % wide)))
        tiles = [padded[y : y + high, x : x + wide] for y in range(0, height, high) for x in range(0, width, wide)]
        data = [predictive.encode_frame(t.astype(np.int64), parts=2, counts=counts, values=values) if kind == 1 else t.astype("<u2").tobytes() for t in tiles]
        layout, offsets, sizes = [(322, 3, (wide,)), (323, 3, (high,))], 324, 325
    starts = [sum(map(len, data[:k])) for k in range(len(data))]

    def written(base):
        tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (16,)), (259, 3, (7 if kind == 1 else 1,)), *layout, (offsets, 4, [base + s for s in starts]), (sizes, 4, [len(d) for d in data])]
        tags += [(50706, 4, (1,)), (50714, 3, BLACK), (50717, 4, (WHITE,)), (50719, 4, CROP[:2]), (50720, 4, CROP[2:])]
        main = [(t, k, len(v), struct.pack(f"{e}{len(v)}{'H' if k == 3 else 'I'}", *v)) for t, k, v in sorted(tags)]
        small = [(256, 4, 1, struct.pack(e + "I", 2)), (257, 4, 1, struct.pack(e + "I", 2)), (273, 4, 1, struct.pack(e + "I", 8)), (279, 4, 1, struct.pack(e + "I", 8)), (271, 2, 5, b"Acme\0")]
        return C.written_tiff([small, main], big)

    return written(len(written(0))) + b"".join(data)


def raw_files(spark, sf_dir):
    """(file_id, content): each image as a file, of three kinds in turn."""
    df = X.plane_u16(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s")).select("image_id", F.transform("s", lambda s: s["v"]).alias("v"))

    def made(batches):
        import pyarrow as pa

        for b in batches:
            data = [raw_file(np.array(v.as_py()).reshape(X.HEIGHT, X.WIDTH), i.as_py() % 3) for i, v in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["file_id", "content"])

    return df.mapInArrow(made, "file_id long, content binary")


MULTIPLIER = f"CAST(trunc(CAST(1073725440.0::DOUBLE / ({WHITE} - b) AS FLOAT)) AS BIGINT)"
DEVELOPED = f"""WITH {X.plane_sql()}, u AS (SELECT *, CAST(CASE 2 * (y & 1) + (x & 1) WHEN 0 THEN 64 WHEN 1 THEN 96 WHEN 2 THEN 128 ELSE 160 END AS BIGINT) AS b FROM plane),
d AS (SELECT image_id AS file_id, y - 2 AS y, x - 4 AS x, greatest(0, least(65535, ((v - b) * {MULTIPLIER} + 8192) >> 14)) AS v FROM u WHERE x >= 4 AND x < 44 AND y >= 2 AND y < 18)"""


@query(f"{DEVELOPED} SELECT file_id, y, x, v FROM d")
def dec_end_to_end_samples(spark, sf_dir):
    """Container, decoder choice, strips and tiles, codec, levels and crop in one plan."""
    return decode.decode(raw_files(spark, sf_dir))[1].select("file_id", "y", "x", "v")


@query(f"""{DEVELOPED}, r AS (SELECT file_id, y, md5(unhex(string_agg(lpad(lower(to_hex(((v & 255) << 8) | (v >> 8))), 4, '0'), '' ORDER BY x))) AS d FROM d GROUP BY ALL)
SELECT file_id, 'DNG' AS decoder, CAST(CASE file_id % 3 WHEN 1 THEN 7 ELSE 1 END AS BIGINT) AS compression, CAST({X.WIDTH} AS BIGINT) AS width, md5(unhex(string_agg(d, '' ORDER BY y))) AS digest FROM r GROUP BY file_id""")
def dec_end_to_end_digests(spark, sf_dir):
    """What a regression run of whole files records: how each was read, and a digest of its samples."""
    images, samples = decode.decode(raw_files(spark, sf_dir))
    return images.select("file_id", "decoder", "compression", "width").join(digest(samples, "file_id"), "file_id")
