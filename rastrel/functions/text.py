"""The few string rules of container metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_spaces(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t"))


def split_string(s: Column, sep: str = " ") -> Column:
    """Parts between separators, empty ones left out."""
    return F.array_remove(F.split(s, f"[{sep}]"), "")


def until_nul(s: Column) -> Column:
    return F.split_part(s, F.lit("\x00"), F.lit(1))


def between_tags(xmp: Column, tag: str) -> Column:
    """What stands between <tiff:tag> and </tiff:tag>; null if either is missing."""
    found = F.regexp_extract(xmp, f"(?s)<tiff:{tag}>(.*?)</tiff:{tag}>", 1)
    return F.when(xmp.rlike(f"(?s)<tiff:{tag}>.*?</tiff:{tag}>"), found)


#: Letters of colour rows and words of colour entries.
LETTERS = {"g": "GREEN", "r": "RED", "b": "BLUE", "f": "FUJI_GREEN", "c": "CYAN", "m": "MAGENTA", "y": "YELLOW"}
WORDS = {"GREEN": "GREEN", "RED": "RED", "BLUE": "BLUE", "FUJIGREEN": "FUJI_GREEN", "CYAN": "CYAN", "MAGENTA": "MAGENTA", "YELLOW": "YELLOW"}


def named(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def color_letter(c: Column) -> Column:
    return named(LETTERS, F.lower(c))


def color_word(c: Column) -> Column:
    return named(WORDS, c)


def color_matrix(rows: Column) -> Column:
    """Three whole numbers of a plane, in ten-thousandths."""
    return F.transform(split_string(rows), lambda n: F.struct(n.cast("int").alias("num"), F.lit(10000).alias("den")))


def nef_mode(bits: Column, compressed: Column, small: Column) -> Column:
    return F.when(small, "sNEF-uncompressed").otherwise(F.concat(bits.cast("string"), F.when(compressed, "bit-compressed").otherwise("bit-uncompressed")))


def extended_mode(width: Column, height: Column, mode: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("-"), mode)


def iso(rating: Column, recommended: Column) -> Column:
    """65535 means that the rating didn't fit: the recommended exposure index then, if there is one."""
    return F.when(rating == 65535, F.coalesce(recommended, rating)).otherwise(rating)


def canon_ev(code: Column) -> Column:
    """Exposure values in 32nds, a third and two thirds by their own codes."""
    size, sign = F.abs(code), F.when(code < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    frac = F.pmod(size, F.lit(32))
    exact = F.when(frac == 12, 10).when(frac == 20, 21).otherwise(frac)
    return sign * (size - frac + exact).cast("double") / 32
