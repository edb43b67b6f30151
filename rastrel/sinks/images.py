"""Portable pixmaps and float maps, one file an image, and text reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixmap(img: np.ndarray) -> bytes:
    """16-bit big-endian samples; an image of (h, w) or (h, w, 3)."""
    h, w = img.shape[:2]
    return f"P{5 if img.ndim == 2 else 6}\n{w} {h}\n65535\n".encode() + img.astype(">u2").tobytes()


def float_map(img: np.ndarray) -> bytes:
    """Little-endian floats, rows from the bottom up; zeros in the header move the samples to a multiple of 16 bytes."""
    h, w = img.shape[:2]
    head = f"P{'f' if img.ndim == 2 else 'F'}\n{w} {h}\n-1.0"
    pad = -(len(head) + 1) % 16
    return f"{head}{'0' * pad}\n".encode() + img[::-1].astype("<f4").tobytes()


def write_images(df: DataFrame, folder: str, width: int, height: int, kind: str = "ppm", key: str = "image_id") -> DataFrame:
    """Writes df (key, y, x, v), an image to a file; returns (key, path, bytes). A task holds one image; a file that is written again is the same."""
    make = {"ppm": pixmap, "pfm": float_map}[kind]
    rows = df.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("r")).select(key, "y", F.transform("r", lambda s: s["v"].cast("double")).alias("r"))
    images = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "r"))).alias("rows")).select(F.col(key).cast("long").alias("id"), F.transform("rows", lambda s: s["r"]).alias("rows"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = make(np.array(r.as_py()).reshape(height, width))
                files, where = fs.FileSystem.from_uri(folder)
                files.create_dir(where, recursive=True)
                with files.open_output_stream(f"{where}/{i}.{kind}") as out:
                    out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([f"{folder}/{i}.{kind}"]), pa.array([len(data)], pa.int64())], names=["id", "path", "bytes"])

    return images.mapInArrow(written, "id long, path string, bytes long")


def report(fields: dict[str, Column]) -> Column:
    """Lines of key and value, in order; nulls as (none)."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("(none)"))) for k, v in fields.items()])


def four_decimals(values: Column) -> Column:
    """Coefficients with six decimals, those that are unknown as nan."""
    return F.array_join(F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), "nan").otherwise(F.format_string("%f", v))), " ")
