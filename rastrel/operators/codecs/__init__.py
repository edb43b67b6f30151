"""Codecs whose bit streams depend on their own data: Arrow-batched functions, one call for each independent unit (tile, strip or file).

A decoder turns bytes into differences by walking the bits; predictions are then sums over whole lines in numpy. Each has
an encoder, so that round trips can be tested. decoded() applies them to a DataFrame of units.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import adaptive, planes, predictive
from .bits import CodecError

Decoder = Callable[..., np.ndarray]

#: name -> decoder(data, width, height, **parameters); hosts may add their own.
REGISTRY: dict[str, Decoder] = {
    "prefix_rows": predictive.decode_rows,
    "prefix_frames": predictive.decode_frame,
    "paired_lengths": predictive.decode_pairs,
    "v1": predictive.decode_v1,
    "columns": predictive.decode_columns,
    "length_nibbles": predictive.decode_segments,
    "adaptive_lengths": predictive.decode_strip,
    "gradient": adaptive.decode_gradient,
    "group_lengths": adaptive.decode_groups,
    "packets14": adaptive.decode_packets,
    "scaled_packets": adaptive.decode_scaled,
    "run_blocks": adaptive.decode_blocks,
    "sliced_frames": predictive.decode_sliced,
    "float_planes": planes.decode_planes,
}



def in_words(img: np.ndarray, encode: Callable[[np.ndarray], bytes]) -> bytes:
    """An image of whole numbers of any size, for codecs of 16 bits: planes of 16-bit words, the lowest first, each behind its number of bytes. Negative numbers have all four."""
    out, rest = b"", img.astype(np.int64)
    for _ in range(4):
        data = encode(rest & 0xFFFF)
        out += struct.pack("<I", len(data)) + data
        rest = rest >> 16
        if not rest.any():
            break
    return out


def of_words(data: bytes, width: int, height: int, run: Decoder, **parameters: object) -> np.ndarray:
    """The inverse of in_words()."""
    at, words = 0, []
    while at < len(data) or not words:
        end = at + 4 + struct.unpack_from("<I", data, at)[0]
        if end > len(data) or len(words) == 4:
            raise CodecError("a plane of words ends too early, or is one too many")
        words.append(run(data[at + 4 : end], width, height, **parameters).astype(np.int64) << 16 * len(words))
        at = end
    return np.bitwise_or.reduce(words)


OUT = "unit_id long, y int, v array<double>, error string"


def decoded(units: DataFrame, codec: str, words: bool = False, **parameters: object) -> DataFrame:
    """(unit_id, y, v, error) of units (unit_id, data, width, height): a row for each line, or one with an error for a unit that can't be decoded. words: data are as in_words() makes them."""
    if codec not in REGISTRY:
        raise ValueError(f"unknown codec {codec}")
    run = partial(of_words, run=REGISTRY[codec]) if words else REGISTRY[codec]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, w, h in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    img, error = run(data or b"", w, h, **parameters), None
                except (CodecError, LookupError, ValueError, ArithmeticError, MemoryError, TypeError, struct.error, zlib.error) as e:  # damaged bytes fail in many ways; a unit's failure is its own
                    img, error = np.empty((0, w or 0)), str(e) or type(e).__name__
                n = max(1, len(img))
                if len(img):
                    width = img.shape[1]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(img, np.float64).ravel()))
                else:
                    values = pa.nulls(1, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(range(n) if len(img) else [None], pa.int32()), values, pa.array([error] * n, pa.string())], names=["unit_id", "y", "v", "error"])

    return units.select("unit_id", "data", "width", "height").mapInArrow(lines, OUT)


__all__ = ["REGISTRY", "CodecError", "decoded", "in_words", "of_words"]
