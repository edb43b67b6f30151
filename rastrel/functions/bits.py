"""Bit arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low(n: int) -> Column:
    return F.lit((1 << n) - 1).cast("long")


def clamp_bits(v: Column, n: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(v.cast("long"), low(n)))


def is_int_n(v: Column, n: int) -> Column:
    return (v >= 0) & (v <= low(n))


def extract_low_bits(v: Column, n: int) -> Column:
    return v.cast("long").bitwiseAND(low(n))


def extract_high_bits(v: Column, n: int, width: int) -> Column:
    return F.shiftrightunsigned(v.cast("long"), width - n)


def sign_extend(v: Column, n: int) -> Column:
    return F.shiftright(F.shiftleft(v.cast("long"), 64 - n), 64 - n)


def extend(v: Column, n: Column | int) -> Column:
    """A difference of n bits: codes without the top bit are negative, counted from below; not two's complement."""
    n = F.lit(n) if isinstance(n, int) else n
    span = F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(n - 1, F.lit(0)).cast("int"))
    return F.when(n == 0, F.lit(0).cast("long")).when(v < half, v - span + 1).otherwise(v)


def is_power_of_two(v: Column) -> Column:
    """Zero counts."""
    return v.bitwiseAND(-v) == v


def active_bits(v: Column) -> Column:
    """Bits up to the highest that is set."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def round_down(v: Column, m: int) -> Column:
    return v if m == 0 else v - F.pmod(v, F.lit(m))


def round_up(v: Column, m: int) -> Column:
    return v if m == 0 else F.floor((v + m - 1) / m) * m


def round_up_division(v: Column, d: int) -> Column:
    return F.when(v == 0, 0).otherwise(1 + F.floor((v - 1) / d))


def is_aligned(v: Column, m: int) -> Column:
    return F.lit(True) if m == 0 else F.pmod(v, F.lit(m)) == 0


def number(data: Column, at: Column | int, n: int, big: bool = False) -> Column:
    """The unsigned number in n bytes (7 at most) from a 0-based place; null where they aren't all there."""
    at = F.lit(at) if isinstance(at, int) else at
    raw = F.substring(data, at + 1, F.lit(n))
    raw = raw if big else F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), 1)), ""))
    return F.when((at >= 0) & (at + n <= F.length(data)), F.conv(F.hex(raw), 16, 10).cast("long"))


def byte_at(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("long")


def padded(data: Column, n: int) -> Column:
    """At least n bytes, zeros behind."""
    return F.rpad(data, n, F.unhex(F.lit("00")))


def split_number(v: Column, parts: int, bits: int) -> Column:
    """A number cut into `parts` of so many bits, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.call_function("shiftright", v, (i * bits).cast("int")).bitwiseAND(low(bits)))


def joined_number(parts: Column, bits: int) -> Column:
    return F.aggregate(F.reverse(parts), F.lit(0).cast("long"), lambda s, p: F.shiftleft(s, bits).bitwiseOR(p.cast("long")))
