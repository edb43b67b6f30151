"""Deflated tiles of floating-point samples: bytes of equal rank together, as differences."""

from __future__ import annotations

import zlib

import numpy as np

from .bits import CodecError

#: Steps of a row's byte differences, by predictor number.
STEPS = {3: 1, 34894: 2, 34895: 4}


def half_width(bits: np.ndarray, exponent: int, fraction: int) -> np.ndarray:
    """Doubles of narrow floats."""
    e, f = bits >> fraction & (1 << exponent) - 1, bits & (1 << fraction) - 1
    bias, top = (1 << exponent - 1) - 1, (1 << exponent) - 1
    v = np.where(e == 0, f * 2.0 ** (1 - bias - fraction), np.ldexp(1 + f / (1 << fraction), (e - bias).astype(np.int32)))
    v = np.where(e == top, np.where(f == 0, np.inf, np.nan), v)
    return np.where(bits >> exponent + fraction & 1, -v, v)


def decode_planes(data: bytes, width: int, height: int, bits: int = 32, predictor: int = 3, parts: int = 1, tile_width: int | None = None) -> np.ndarray:
    """A tile of which width x height samples are taken; tile_width: samples of its stored rows."""
    if predictor not in STEPS or bits not in (16, 24, 32):
        raise CodecError(f"predictor {predictor} of {bits} bits")
    n, w, step = bits // 8, tile_width or width, STEPS[predictor] * parts
    try:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
    except zlib.error as e:
        raise CodecError(f"a tile can't be inflated: {e}") from None
    if len(raw) < n * w * height:
        raise CodecError("a tile is too short")
    rows = raw[: n * w * height].reshape(height, -1, step) if n * w % step == 0 else None
    if rows is None:
        raise CodecError("a row is no multiple of its components")
    planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(height, n, w)[:, :, :width].astype(np.uint32)
    whole = sum(planes[:, i] << np.uint32(8 * (n - 1 - i)) for i in range(n))
    if bits == 32:
        return whole.astype(np.uint32).view(np.float32).astype(np.float64)
    return half_width(whole.astype(np.int64), *((5, 10) if bits == 16 else (7, 16)))


def encode_planes(img: np.ndarray, bits: int = 32, predictor: int = 3) -> bytes:
    """The inverse, of single or half precision."""
    own = img.astype(">f4" if bits == 32 else ">f2")
    planes = own.view(np.uint8).reshape(*img.shape, bits // 8).transpose(0, 2, 1).reshape(img.shape[0], -1)
    step = STEPS[predictor]
    d = planes.copy()
    d[:, step:] -= planes[:, :-step]
    return zlib.compress(d.tobytes())
