"""Fixed-width samples from packed bytes.

A layout says at which bit of a row each sample begins. Rows of bytes are cut and their samples shifted out by arrays, a
chunk of rows at a time, in one Arrow call a batch: column expressions took half a microsecond a sample, most of it to
turn bytes into numbers. A row shorter than it must be is an error row, never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By order: bytes of a word whose bytes are swapped before its high bits come first.
SWAPPED = {"msb": 1, "msb16": 2, "msb32": 4}
#: Samples of an Arrow batch, about.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Layout:
    """First bits of the samples of a row, their number of bits (24 at most) and the order of bits: lsb takes low bits first; msb high bits first; msb16 and msb32 the same after swapping the bytes of each word of two or four."""

    starts: tuple[int, ...]
    bits: int
    order: str = "msb"

    def taken(self, rows: np.ndarray) -> np.ndarray:
        """Samples (row, x) of rows of bytes; bits beyond a row's end are zero."""
        columns = np.ascontiguousarray(rows.T).astype(np.int64)
        none = np.zeros(len(rows), np.int64)
        out = np.empty((len(self.starts), len(rows)), np.int64)
        for k, first in enumerate(self.starts):
            at, skip = divmod(first, 8)
            places = range(at, at + (skip + self.bits + 7) // 8)
            w = SWAPPED.get(self.order, 1)
            own = [columns[p] if (p := i // w * w + w - 1 - i % w) < len(columns) else none for i in places]
            own, down = (own[::-1], skip) if self.order == "lsb" else (own, 8 * len(own) - skip - self.bits)
            whole = own[0]
            for c in own[1:]:
                whole = whole << 8 | c
            out[k] = whole >> down & (1 << self.bits) - 1
        return out.T


def bytes_of(data: str | Column) -> Column:
    """A binary column as an array of numbers."""
    hexes = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))


def packed(n: int, bits: int, order: str = "msb", start: int = 0) -> Layout:
    """n samples of `bits` bits, one behind the other."""
    return Layout(tuple(start + k * bits for k in range(n)), bits, order)


def rows_of(df: DataFrame, data: str, pitch: int, height: int | None = None) -> DataFrame:
    """df with a row for each line of `pitch` bytes: y and row (binary). height: lines that must be there, else one row with an error."""
    n = F.floor(F.length(data) / pitch).cast("int")
    lines = n if height is None else F.lit(height)
    short = n < lines
    # cut before they are rows: else each row would carry all the data
    parts = F.transform(F.sequence(F.lit(0), lines - 1), lambda y: F.substring(data, y * pitch + 1, F.lit(pitch)))
    parts = F.when(short | (lines < 1), F.array(F.lit(None).cast("binary"))).otherwise(parts)
    out = df.select(*[c for c in df.columns if c not in (data, "y", "row", "error")], F.posexplode(parts).alias("y", "row"))
    return out.withColumns({"y": F.when(F.col("row").isNull(), -1).otherwise(F.col("y")), "error": F.when(F.col("row").isNull(), "not enough bytes")})


def samples(df: DataFrame, taken: Callable[[np.ndarray], np.ndarray], pitch: int) -> DataFrame:
    """(id, y, x, v): a row for each sample of df (an id, and data whose lines are `pitch` bytes each). taken: samples (line, x) of lines of bytes. What is left of data behind whole lines is no line."""
    key, data = df.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines = b.column(0), [np.frombuffer(d.as_buffer(), np.uint8) if d.is_valid else np.empty(0, np.uint8) for d in b.column(1)]
            lines = [d[: len(d) // pitch * pitch].reshape(-1, pitch) for d in lines]
            counts = np.array([len(d) for d in lines], np.int64)
            if not counts.sum():
                continue
            rows = np.concatenate(lines)
            own, y = np.repeat(np.arange(len(counts)), counts), np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            n = taken(rows[:1]).shape[1]
            step = max(1, CHUNK // n)
            for k in range(0, len(rows), step):
                v = taken(rows[k : k + step])
                at = pa.array(np.repeat(own[k : k + step], n))
                xs = np.tile(np.arange(n, dtype=np.int32), len(v))
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.repeat(y[k : k + step].astype(np.int32), n)), pa.array(xs), pa.array(np.ascontiguousarray(v).ravel())], names=[key, "y", "x", "v"])

    return df.select(key, data).mapInArrow(made, f"{key} {df.schema[key].dataType.simpleString()}, y int, x int, v long")


def with_control(n: int, big: bool = True) -> Layout:
    """12-bit samples, two in three bytes, and a byte to leave out after every ten samples."""
    return Layout(tuple(8 * (k // 2 * 3 + k // 10) + k % 2 * 12 for k in range(n)), 12, "msb" if big else "lsb")


def left_aligned(n: int, big: bool = False) -> Layout:
    """12-bit samples in the upper bits of 16."""
    return Layout(tuple(16 * k + (0 if big else 4) for k in range(n)), 12, "msb" if big else "lsb")


def packets(n: int, bits: int = 14) -> Layout:
    """Packets of 16 bytes, each with as many samples as fit, low bits first."""
    per = 128 // bits
    return Layout(tuple(k // per * 128 + k % per * bits for k in range(n)), bits, "lsb")


def halves_swapped(data: str | Column, block: int, split: int) -> Column:
    """Blocks whose part from `split` on is stored before the rest; the last block may be shorter."""
    n = F.ceil(F.length(data) / block).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * block + 1, F.lit(block)))
    turned = F.transform(parts, lambda p: F.concat(F.hex(F.substring(p, block - split + 1, F.lit(split))), F.hex(F.substring(p, F.lit(1), F.lit(block - split)))))
    return F.when(F.length(data) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(turned, "")))


def extremes_and_deltas(rows: np.ndarray) -> np.ndarray:
    """Samples (row, x) of rows of packets of 16 bytes, each 16 samples: greatest, least, their places, and 7-bit steps above the least, scaled to fit; 11 bits, doubled.

    Where greatest and least share a place, the last step is read beyond the packet, zeros behind the row's last one.
    """
    n = rows.shape[1] // 16
    packets = np.pad(rows, ((0, 0), (0, 16)))
    packets = np.concatenate([packets[:, p * 16 : p * 16 + 32] for p in range(n)])  # with what follows
    hi, lo = Layout((0, 11), 11, "lsb").taken(packets).T[:, :, None]
    ihi, ilo = Layout((22, 26), 4, "lsb").taken(packets).T[:, :, None]
    steps = Layout(tuple(30 + 7 * j for j in range(15)), 7, "lsb").taken(packets)
    shift, k = sum((0x80 << s <= hi - lo).astype(np.int64) for s in range(4)), np.arange(16)
    before = (ihi < k).astype(np.int64) + ((ilo < k) & (ilo != ihi))
    step = np.take_along_axis(steps, np.minimum(k - before, 14), axis=1) << shift
    v = np.where(k == ihi, hi, np.where(k == ilo, lo, np.minimum(0x7FF, step + lo))) * 2
    return v.reshape(n, len(rows), 16).transpose(1, 0, 2).reshape(len(rows), n * 16)


def interleaved(y: Column, height: int) -> Column:
    """The row of the frame that the y-th stored row is, where even rows come before odd ones."""
    even = (height + 1) // 2
    return F.when(y < even, y * 2).otherwise((y - even) * 2 + 1)

