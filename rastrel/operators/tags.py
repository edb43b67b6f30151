"""Trees of tagged entries as rows (file_id, ifd, dfs, tag, kind, num): dfs is the place in a depth-first walk, found when the file is parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of values, number -> name and bytes.
KINDS = {0: ("NONE", 0), 1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1), 7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8), 13: ("OFFSET", 4)}
INTEGERS, FLOATS, RATIONALS, STRINGS = (1, 3, 4, 6, 8, 9, 13), (11, 12), (5, 10), (2,)


def last_entry_wins(entries: DataFrame) -> DataFrame:
    """One entry for each tag of a directory: the last one parsed."""
    keys = ["file_id", "ifd", "tag"]
    one = F.max_by(F.struct(*[c for c in entries.columns if c not in keys]), F.struct("dfs", "num"))
    return entries.groupBy(*keys).agg(one.alias("e")).select(*keys, "e.*")


def directories_with(entries: DataFrame, tag: int) -> DataFrame:
    """(file_id, ifd, place): the directories that own a tag, in depth-first order from 0."""
    w = Window.partitionBy("file_id").orderBy("dfs", "ifd")
    return entries.filter(F.col("tag") == tag).groupBy("file_id", "ifd").agg(F.min("dfs").alias("dfs")).withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def directory_with(entries: DataFrame, tag: int, index: int = 0) -> DataFrame:
    return directories_with(entries, tag).filter(F.col("place") == index).drop("place")


def first_entry(entries: DataFrame, tag: int) -> DataFrame:
    """The first entry of a tag anywhere in each file's tree."""
    return entries.filter(F.col("tag") == tag).groupBy("file_id").agg(F.min_by(F.struct("ifd", "kind", "num"), F.struct("dfs", "ifd", "num")).alias("e")).select("file_id", "e.*")


def with_tag(files: DataFrame, entries: DataFrame, tag: int) -> DataFrame:
    """files whose tree has a tag anywhere."""
    return files.join(entries.filter(F.col("tag") == tag).select("file_id"), "file_id", "left_semi")


def directories_where(entries: DataFrame, tag: int, test: Column) -> DataFrame:
    """Directories whose entry of a tag passes a test."""
    return entries.filter((F.col("tag") == tag) & test).select("file_id", "ifd").distinct()


def usable_chunks(chunks: DataFrame, subfile: str = "subfile", compression: str = "compression", known: tuple[int, ...] = (1, 7, 8, 9, 0x884C)) -> DataFrame:
    """Raw directories that are neither previews (bit 0) nor masks (bit 2) and of a compression that can be decoded."""
    return chunks.filter((F.col(subfile).bitwiseAND(F.lit(5)) == 0) & F.col(compression).isin(*known))


def kind_flags(kind: str = "kind") -> dict[str, Column]:
    k = F.col(kind)
    return {"is_int": k.isin(*INTEGERS), "is_float": k.isin(*INTEGERS, *FLOATS, *RATIONALS), "is_rational": k.isin(*INTEGERS, *RATIONALS), "is_string": k.isin(*STRINGS)}


def kind_size(kind: Column) -> Column:
    sizes = F.array(*[F.lit(n) for _, n in KINDS.values()])
    return F.get(sizes, kind.cast("int"))


def largest_image(entries: DataFrame, width: int) -> DataFrame:
    """For each file the directory whose width tag is greatest, the first of such in the walk."""
    w = Window.partitionBy("file_id").orderBy(F.desc("num"), "dfs", "ifd")
    return entries.filter(F.col("tag") == width).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("file_id", "ifd", "num")


def first_match(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    (name, test), *rest = rules
    return reduce(lambda c, r: c.when(r[1], r[0]), rest, F.when(test, name))


def has_too_many_errors(errors: DataFrame, most: int) -> DataFrame:
    """For each file with `most` errors or more their number and the first message."""
    return errors.groupBy("file_id").agg(F.count("*").alias("n"), F.min_by("message", "ord").alias("first")).filter(F.col("n") >= most)


#: Makers by decoder, in the order that they are tried after the formats that are known by other marks.
MAKERS = {
    "CR2": ("Canon",), "NEF": ("NIKON CORPORATION", "NIKON"), "ORF": ("OLYMPUS IMAGING CORP.", "OLYMPUS CORPORATION", "OLYMPUS OPTICAL CO.,LTD", "OM Digital Solutions"),
    "ARW": ("SONY",), "PEF": ("PENTAX Corporation", "RICOH IMAGING COMPANY, LTD.", "PENTAX"), "RW2": ("Panasonic", "LEICA", "LEICA CAMERA AG"), "SRW": ("SAMSUNG",), "MEF": ("Mamiya-OP Co.,Ltd.",),
    "DCR": ("Kodak",), "DCS": ("KODAK",), "KDC": ("EASTMAN KODAK COMPANY",), "ERF": ("SEIKO EPSON CORP.",), "STI": ("Sinar AG",), "3FR": ("Hasselblad",),
}


def decoder(make: Column, model: Column, has_dng: Column, iiq_magic: Column, software: Column) -> Column:
    """Which decoder takes a TIFF-like file: an ordered list of rules, the first that holds."""
    make = F.btrim(make, F.lit(" \t"))
    leaf = make == "Leaf"
    rules = [
        ("DNG", has_dng),
        ("MOS", (leaf & ~iiq_magic) | (make.isNull() & software.startswith("Camera Library"))),
        ("IIQ", iiq_magic & make.isin("Phase One A/S", "Phase One", "Leaf")),
        ("CR2", (make == "Kodak") & model.isin("DCS520C", "DCS560C")),
        *[(name, make.isin(*makes)) for name, makes in MAKERS.items()],
    ]
    return first_match([(n, F.coalesce(t, F.lit(False))) for n, t in rules])


def file_kind(size: Column, head: Column, chdk: Column) -> Column:
    """How a file is read, by its first bytes and, for headerless ones, a size that the catalog knows."""
    starts = lambda hex_: F.startswith(F.hex(head), F.lit(hex_))
    tiff = starts("49492A00") | starts("4D4D002A") | starts("4949524F") | starts("49495253") | starts("49495500")
    return first_match([
        ("too small", size <= 104), ("MRW", starts("004D524D")), ("RAF", starts("46554A4946494C4D")), ("TIFF", tiff), ("CIFF", starts("4949") & (F.hex(F.substring(head, 7, 8)) == "4845415043434452")), ("naked", chdk),
    ])


def nef_uncompressed(bytes_: Column, bits: Column, width: Column, height: Column) -> Column:
    """Whether a strip holds its samples plainly: just enough bytes, or the same few more in each row."""
    samples, needed = F.floor(bytes_ * 8 / bits), width * height
    spare = bytes_ - F.floor(needed * bits / 8)
    return (samples == needed) | ((samples > needed) & (F.pmod(spare, height) == 0) & (F.floor(spare / height) < 16))


def raf_compressed(bytes_: Column, bits: Column, width: Column, height: Column) -> Column:
    return F.floor(bytes_ * 8 / (width * height)) < bits


#: The aspect ratios that a sensor offers, in the order in which ties go.
RATIOS = (("16:9", 16 / 9), ("3:2", 3 / 2), ("4:3", 4 / 3), ("1:1", 1.0))


def nearest_ratio(width: Column, height: Column) -> Column:
    ratio = width.cast("double") / height
    options = F.array(*[F.struct(F.abs(ratio - F.lit(r)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, r) in enumerate(RATIOS)])
    return F.array_min(options)["n"]
