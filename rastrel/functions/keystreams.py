"""Keys that hide metadata in some files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import byte_at

START = 0x60


def serial_number(serial: Column) -> Column:
    """Digits as they are, anything else by its code modulo 10."""
    codes = F.transform(F.split(serial, ""), lambda c: F.pmod(F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(0), F.lit(10)))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, d: s * 10 + d)


def unscrambled(data: Column, n: int, ci: Column, cj: Column) -> Column:
    """n bytes, each under a key that grows by ci times a counter: in closed form, so no byte waits for another. ci, cj: what the host's tables give for serial and key."""

    def one(k: Column) -> Column:
        key = cj + ci * ((k + 1) * START + F.floor(k * (k + 1) / 2))
        return byte_at(data, k).bitwiseXOR(F.pmod(key, F.lit(256)).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def pad(key: int, n: int) -> np.ndarray:
    """n 32-bit words of a shift-register stream, as they stand in memory: four congruential words, then xors of words two and four (and 126 and 62) back."""
    w, u = [], 0xFFFFFFFF
    for _ in range(4):
        key = key * 48828125 + 1 & u
        w.append(key)
    w[3] = (w[3] << 1 | (w[0] ^ w[2]) >> 31) & u
    while len(w) < 127:
        w.append(((w[-4] ^ w[-2]) << 1 | (w[-3] ^ w[-1]) >> 31) & u)
    out = [int.from_bytes(x.to_bytes(4, "little"), "big") for x in w]
    stream = list(out)
    while len(stream) < 127 + n:
        stream.append(stream[-127] ^ stream[-63])
    return np.array(stream[127:], np.uint32)


def xored(data: bytes, key: int) -> bytes:
    words = np.frombuffer(data, "<u4")
    return (words ^ pad(key, len(words))).astype("<u4").tobytes()
