"""Lists of correction opcodes, applied as a fold of DataFrame transforms; new ones are added to the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from . import pixels as P


@dataclass(frozen=True)
class Opcode:
    """code; rect: top, left, bottom, right; pitch: of rows and columns; flags: bit 0 for one that may be left out."""

    code: int
    rect: tuple[int, int, int, int] = (0, 0, 0, 0)
    pitch: tuple[int, int] = (1, 1)
    params: tuple[float, ...] = ()
    flags: int = 0

    @property
    def roi(self):
        return P.in_roi(*self.rect, *self.pitch)


def _table(df: DataFrame, op: Opcode) -> DataFrame:
    if not 1 <= len(op.params) <= 65536:
        raise ValueError("a table has 1 to 65536 entries")
    return P.mapped(df, op.roi, P.looked_up(F.col("v"), [int(p) for p in op.params]))


def _polynomial(df: DataFrame, op: Opcode) -> DataFrame:
    if len(op.params) > 9:
        raise ValueError("a polynomial has a degree of 8 at most")
    return P.mapped(df, op.roi, P.polynomial(F.col("v"), list(op.params)))


def _by_line(axis: str, combine: Callable, limit: float | None = None) -> Callable[[DataFrame, Opcode], DataFrame]:
    def run(df: DataFrame, op: Opcode) -> DataFrame:
        if limit is not None and any(abs(p) > limit for p in op.params):
            raise ValueError("an offset is beyond the full scale")
        first, pitch = (op.rect[0], op.pitch[0]) if axis == "y" else (op.rect[1], op.pitch[1])
        factors = df.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(op.params)], "i long, f double")
        out = P.by_line(df, axis, factors, first, pitch)
        return P.mapped(out, op.roi, F.coalesce(combine(F.col("v"), F.col("f")), F.col("v"))).select(*df.columns)

    return run


def _trim(df: DataFrame, op: Opcode) -> DataFrame:
    top, left, bottom, right = op.rect
    return G.inside(df, G.Rect(left, top, right - left, bottom - top)).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def _bad(df: DataFrame, op: Opcode) -> DataFrame:
    """Marks samples of one value, or (params beyond the first: x, y pairs) at given places."""
    mark = F.col("v") == int(op.params[0]) if op.code == 4 else F.struct("x", "y").isin(*[F.struct(F.lit(int(x)), F.lit(int(y))) for x, y in zip(op.params[::2], op.params[1::2], strict=True)])
    old = F.col("bad") if "bad" in df.columns else F.lit(False)
    return df.withColumn("bad", old | mark)


#: Code -> (name, transform); None: known, but not applied.
REGISTRY: dict[int, tuple[str, Callable[[DataFrame, Opcode], DataFrame] | None]] = {
    1: ("WarpRectilinear", None),
    2: ("WarpFisheye", None),
    3: ("FixVignetteRadial", None),
    4: ("FixBadPixelsConstant", _bad),
    5: ("FixBadPixelsList", _bad),
    6: ("TrimBounds", _trim),
    7: ("MapTable", _table),
    8: ("MapPolynomial", _polynomial),
    9: ("GainMap", None),
    10: ("DeltaPerRow", _by_line("y", P.offset_u16, 1.0)),
    11: ("DeltaPerColumn", _by_line("x", P.offset_u16, 1.0)),
    12: ("ScalePerRow", _by_line("y", P.gain_u16)),
    13: ("ScalePerColumn", _by_line("x", P.gain_u16)),
}


def applied(df: DataFrame, ops: list[Opcode], width: int, height: int) -> DataFrame:
    """df (image_id, y, x, v) after all opcodes, in their order; each later area counts from what a trim left."""
    for op in ops:
        if op.code not in REGISTRY:
            raise ValueError(f"unknown opcode {op.code}")
        name, run = REGISTRY[op.code]
        top, left, bottom, right = op.rect
        if run is None:
            if not op.flags & 1:
                raise ValueError(f"{name} can't be applied")
            continue
        if op.code not in (4, 5) and not (0 <= top <= bottom <= height and 0 <= left <= right <= width):
            raise ValueError(f"{name}: its area is not inside the image")
        df = run(df, op)
        if op.code == 6:
            width, height = right - left, bottom - top
    return df
