"""Colour filter patterns: arrays in row order, periodic in both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAYER = {"RGGB": (0, 0), "GRBG": (1, 0), "GBRG": (0, 1), "BGGR": (1, 1)}
#: Bits of a colour in the packed form.
PACKED = {"RED": 0, "GREEN": 1, "BLUE": 2, "FUJI_GREEN": 3, "MAGENTA": 0, "YELLOW": 1, "CYAN": 2}
#: The six-by-six pattern at phase (0, 0).
XTRANS = ("GGRGGB", "GGBGGR", "BRGRBG", "GGBGGR", "GGRGGB", "RBGBRG")


def pattern(colors: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in colors])


def at(cfa: Column, w: int, h: int, x: Column, y: Column) -> Column:
    return F.get(cfa, (F.pmod(y, F.lit(h)) * w + F.pmod(x, F.lit(w))).cast("int"))


def color_at(colors: list[str], w: int, h: int, x: Column, y: Column) -> Column:
    return at(pattern(colors), w, h, x, y)


def shifted(cfa: Column, w: int, h: int, dx: Column | int, dy: Column | int) -> Column:
    """The pattern as seen from dx columns further right and dy rows further down."""
    dx, dy = (F.lit(d) if isinstance(d, int) else d for d in (dx, dy))
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: at(cfa, w, h, F.pmod(i, F.lit(w)) + dx, F.floor(i / w) + dy))


def as_text(cfa: Column, w: int, h: int) -> Column:
    rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.array_join(F.slice(cfa, y * w + 1, F.lit(w)), ","))
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def packed_filter(cfa: Column, w: int, h: int) -> Column:
    """Two bits for each place of two columns and eight rows; 9 for six by six, 1 for what can't be packed."""
    if (w, h) == (6, 6):
        return F.lit(9).cast("long")
    if w > 2 or h > 8 or h & (h - 1) or not w * h:
        return F.lit(1).cast("long")
    codes = F.create_map(*[F.lit(v) for kv in PACKED.items() for v in kv])
    cells = [(x, y) for y in range(8) for x in range(2)]
    return sum((F.shiftleft(codes[at(cfa, w, h, F.lit(x), F.lit(y))].cast("long"), 2 * x + 4 * y) for x, y in cells), F.lit(0).cast("long"))


def shifted_filter(f: Column, dx: int, dy: int) -> Column:
    """A packed filter seen from elsewhere: an odd column step swaps neighbours, a row step turns the word by four bits."""
    if dx % 2:
        f = F.shiftright(f.bitwiseAND(F.lit(0xCCCCCCCC)), 2).bitwiseOR(F.shiftleft(f.bitwiseAND(F.lit(0x33333333)), 2))
    n = dy * 4 % 32
    return F.shiftright(f, n).bitwiseOR(F.shiftleft(f, 32 - n)).bitwiseAND(F.lit(0xFFFFFFFF)) if n else f


def bayer_phase(cfa: Column) -> Column:
    """The phase of a two-by-two pattern, null if it is none."""
    names = {"R": "RED", "G": "GREEN", "B": "BLUE"}
    out: Column = F.lit(None).cast("string")
    for phase in BAYER:
        out = F.when(cfa == pattern([names[c] for c in phase]), phase).otherwise(out)
    return out


def rephased(data: Column, source: str, target: str, keep_greens: bool = False) -> Column:
    """Four values of one phase at the places of another; keep_greens: both greens stay in their order."""
    (sx, sy), (tx, ty) = BAYER[source], BAYER[target]
    dx, dy = abs(tx - sx), abs(ty - sy)
    order = [((r + dy) % 2) * 2 + (c + dx) % 2 for r in range(2) for c in range(2)]
    if keep_greens and dy:
        a, b = (i for i, c in enumerate(target) if c == "G")
        order[a], order[b] = order[b], order[a]
    return F.array(*[F.get(data, F.lit(i)) for i in order])


def xtrans(dx: int, dy: int) -> list[str]:
    return [XTRANS[(y + dy) % 6][(x + dx) % 6] for y in range(6) for x in range(6)]


def xtrans_phase(letters: Column) -> Column:
    """(x, y) of a six-by-six pattern of letters, the first in row order; null if it is none."""
    out: Column = F.lit(None).cast("struct<x:int,y:int>")
    for dy in reversed(range(6)):
        for dx in reversed(range(6)):
            out = F.when(F.array_join(letters, "") == "".join(xtrans(dx, dy)), F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y"))).otherwise(out)
    return out
