"""Tag trees of container files as rows, parsed with a work list and not by recursion.

entries() maps (file_id, content) to one row for each entry: ifd is the directory's path ("0" the first, "0.1" its
second child), dfs its place in a depth-first walk. A directory that can't be read ends its chain; what came before it
stays. A file that is no container at all gives one row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.tags import KINDS

#: Tags whose values are directories.
SUB_IFDS, EXIF, FUJI_RAW, MAKERNOTE, MAKE = 330, 34665, 0xF000, 37500, 271
MAGIC = (42, 0x4F52, 0x5352, 0x55)
MOST_DEPTH, MOST_CHILDREN, MOST_BELOW = 5, 10, 28


class ContainerError(Exception):
    """A file, or a directory of it, that can't be read."""


@dataclass
class Entry:
    tag: int
    kind: int
    count: int
    value: bytes
    big: bool


@dataclass
class Directory:
    entries: list[Entry] = field(default_factory=list)
    children: list["Directory"] = field(default_factory=list)
    depth: int = 0

    def last_wins(self) -> list[Entry]:
        return list({e.tag: e for e in self.entries}.values())

    def walk(self, path: str = "0") -> Iterator[tuple[str, "Directory"]]:
        yield path, self
        for i, c in enumerate(self.children):
            yield from c.walk(f"{path}.{i}")

    def size(self) -> int:
        return sum(1 for _ in self.walk()) - 1


def order_of(data: bytes, at: int = 0) -> bool:
    """Whether numbers are big-endian, by two letters."""
    mark = data[at : at + 2]
    if mark not in (b"II", b"MM"):
        raise ContainerError("no byte order mark")
    return mark == b"MM"


def number(data: bytes, at: int, n: int, big: bool) -> int:
    if at < 0 or at + n > len(data):
        raise ContainerError("an offset lies outside the file")
    return int.from_bytes(data[at : at + n], "big" if big else "little")


#: Beginnings of maker notes -> (bytes before a new origin, or None to keep the old one; place of the byte order mark; place of the directory).
NOTES: tuple[tuple[bytes, int | None, int | None, int], ...] = (
    (b"AOC\0", None, 4, 6),
    (b"PENTAX", 0, 8, 10),
    (b"FUJIFILM\x0c\0\0\0", 0, None, 12),
    (b"Nikon\0\x02", 10, 0, 8),
    (b"OLYMPUS", 0, None, 12),
    (b"OLYMP", 0, None, 8),
    (b"OM SYSTEM", 0, None, 16),
    (b"EPSON", None, None, 8),
    (b"Apple iOS", 0, 12, 14),
)


class Parser:
    def __init__(self, data: bytes):
        self.data, self.taken = data, set()

    def chain(self, base: int, at: int, big: bool, depth: int = 0, make: str = "") -> list[Directory]:
        """Directories from one offset on, each followed by the offset of the next."""
        out = []
        while at and len(out) < MOST_CHILDREN:
            try:
                d, at = self.directory(base, at, big, depth, make)
            except ContainerError:
                if not out:
                    raise
                break
            out.append(d)
        return out

    def directory(self, base: int, at: int, big: bool, depth: int, make: str) -> tuple[Directory, int]:
        if depth > MOST_DEPTH:
            raise ContainerError("directories lie too deep")
        start = base + at
        n = number(self.data, start, 2, big)
        if start in self.taken:
            raise ContainerError("two directories overlap")
        end = start + 2 + 12 * n
        following = number(self.data, end, 4, big)
        self.taken.add(start)
        d = Directory(depth=depth)
        for p in range(start + 2, end, 12):
            e = self.entry(base, p, big)
            if e is None:
                continue
            if e.tag == MAKE:
                make = e.value.split(b"\0")[0].decode("latin-1").strip(" \t")
            children = self.children(base, e, p, big, depth, make)
            d.children += children[: max(0, MOST_CHILDREN - len(d.children))]
            if not children:
                d.entries.append(e)
        if d.size() > MOST_BELOW:
            raise ContainerError("too many directories")
        return d, following

    def entry(self, base: int, p: int, big: bool) -> Entry | None:
        tag, kind, count = number(self.data, p, 2, big), number(self.data, p + 2, 2, big), number(self.data, p + 4, 4, big)
        if kind not in KINDS:
            raise ContainerError(f"unknown kind {kind}")
        size = KINDS[kind][1] * count
        at = p + 8 if size <= 4 else base + number(self.data, p + 8, 4, big)
        if at + size > len(self.data):
            return None
        return Entry(tag, kind, count, self.data[at : at + size], big)

    def children(self, base: int, e: Entry, p: int, big: bool, depth: int, make: str) -> list[Directory]:
        """Directories that an entry stands for; none if it can't be read as such, and then it stays an entry."""
        try:
            if e.tag in (SUB_IFDS, EXIF, FUJI_RAW):
                return [d for i in range(e.count) for d in self.chain(base, number(e.value, 4 * i, 4, big), big, depth + 1, make)[:1]]
            if e.tag == MAKERNOTE and len(e.value) > 4:
                return [self.note(base, base + number(self.data, p + 8, 4, big), e.value, big, depth, make)]
        except ContainerError:
            pass
        return []

    def note(self, base: int, at: int, value: bytes, big: bool, depth: int, make: str) -> Directory:
        for prefix, origin, mark, place in NOTES:
            if value.startswith(prefix):
                root = at + (origin or 0)
                big = order_of(self.data, root + mark) if mark is not None else False if prefix.startswith(b"FUJI") else big
                return self.directory(base, root + place - base, big, depth + 1, make)[0] if origin is None else self.directory(root, place, big, depth + 1, make)[0]
        if value[6:10] == b"Exif":
            return self.directory(base, at + 20 - base, order_of(value, 12), depth + 1, make)[0]
        if make == "SAMSUNG":
            return self.directory(at, 0, big, depth + 1, make)[0]
        if value[:2] in (b"II", b"MM"):
            return self.directory(base, at + 2 - base, order_of(value), depth + 1, make)[0]
        return self.directory(base, at - base, big, depth + 1, make)[0]


def tiff(data: bytes) -> Directory:
    """The root of a TIFF-like file; its children are the directories of the chain."""
    big = order_of(data)
    if number(data, 2, 2, big) not in MAGIC:
        raise ContainerError("no TIFF magic")
    return Directory(children=Parser(data).chain(0, number(data, 4, 4, big), big))


#: Tags of the other tree format that are kept.
CIFF_KEPT = (0x0032, 0x0036, 0x0102A, 0x1028, 0x102A, 0x102C, 0x1029, 0x102D, 0x10A9, 0x10B5, 0x1031, 0x1033, 0x080A, 0x1804, 0x1810, 0x1818, 0x1834, 0x1835, 0x2005, 0x2007)
CIFF_KINDS = {0x0000: 1, 0x0800: 2, 0x1000: 3, 0x1800: 4, 0x2000: 7}


def ciff(data: bytes, kept: tuple[int, ...] | None = CIFF_KEPT) -> Directory:
    """Directories at the end of their data, entries of ten bytes; kept: tags of interest, None for all."""
    if data[:2] != b"II" or data[6:14] != b"HEAPCCDR":
        raise ContainerError("no CIFF signature")

    def directory(area: bytes, depth: int) -> Directory:
        if depth > MOST_DEPTH or len(area) < 4:
            raise ContainerError("a directory is too short or too deep")
        values = number(area, len(area) - 4, 4, False)
        n = number(area, values, 2, False)
        d, used = Directory(depth=depth), []
        for p in range(values + 2, values + 2 + 10 * n, 10):
            word = number(area, p, 2, False)
            where, kind, tag = word & 0xC000, word & 0x3800, word & 0x3FFF
            if where == 0x4000:
                value = area[p + 2 : p + 10]
            elif where:
                raise ContainerError("unknown place of a value")
            else:
                size, at = number(area, p + 2, 4, False), number(area, p + 6, 4, False)
                if at + size > values:
                    raise ContainerError("a value lies outside its area")
                if any(a == at or a < at + size and at < b for a, b in used):
                    raise ContainerError("two values overlap")
                used.append((at, at + size))
                value = area[at : at + size]
            if kind in (0x2800, 0x3000):
                d.children.append(directory(value, depth + 1))
            elif kept is None or tag in kept:
                shift = 1 if kind == 0x1000 else 2 if kind in (0x1800, 0x2000) else 0
                d.entries.append(Entry(tag, CIFF_KINDS.get(kind, 7), len(value) >> shift, value, False))
        return d

    return directory(data[number(data, 2, 4, False) :], 0)


#: Tags of the short list.
FUJI_SHORTS, FUJI_OFFSETS, FUJI_COUNTS = (0x100, 0x110, 0x111, 0x2FF0), 0xF007, 0xF008


def fiff(data: bytes) -> Directory:
    """Three directories at fixed places: a TIFF, another or plain raw data, and a list of short entries, big-endian."""
    first, third, second = number(data, 0x54, 4, True) + 12, number(data, 0x5C, 4, True), number(data, 0x64, 4, True)
    root = tiff(data[first:])
    extra = Directory(depth=1)
    if 0 < second < len(data):
        try:
            root.children.append(tiff(data[second:]))
        except ContainerError:
            if second <= first:
                raise ContainerError("the second directory is not after the first") from None
            extra.entries += [Entry(FUJI_OFFSETS, 13, 1, struct.pack("<I", second - first), False), Entry(FUJI_COUNTS, 4, 1, struct.pack("<I", len(data) - second), False)]
    if 0 < third < len(data):
        n, at = number(data, third, 4, True), third + 4
        if n > 255:
            raise ContainerError("too many entries")
        for _ in range(n):
            tag, size = number(data, at, 2, True), number(data, at + 2, 2, True)
            short = tag in FUJI_SHORTS
            number(data, at + 4, size, True)
            extra.entries.append(Entry(tag, 3 if short else 7, size // 2 if short else size, data[at + 4 : at + 4 + size], True))
            at += 4 + size
    root.children.append(extra)
    return root


def mrw(data: bytes) -> dict:
    """Geometry, white balance, tags and the place of the samples, from blocks before the image."""
    if data[:4] != b"\0MRM":
        raise ContainerError("no MRW magic")
    end = 8 + number(data, 4, 4, True)
    at, out = 8, {"tags": None, "wb": None}
    while at < end:
        tag, n = number(data, at, 4, True), number(data, at + 4, 4, True)
        body = data[at + 8 : at + 8 + n]
        if not n or at + 8 + n > end:
            raise ContainerError("a block has no length, or too much of it")
        if tag == 0x505244:
            h, w, bits, pixel, method = number(body, 8, 2, True), number(body, 10, 2, True), body[16], body[17], body[18]
            if not (0 < w <= 3280 and 0 < h <= 2456) or bits not in (12, 16) or pixel != 12 or method not in (0x52, 0x59) or (bits == 12) != (method == 0x59) or h * w * bits % 8:
                raise ContainerError("unexpected geometry")
            out |= {"width": w, "height": h, "bits": bits, "packed": method == 0x59}
        elif tag == 0x545457:
            out["tags"] = tiff(body)
        elif tag == 0x574247:
            out["wb"] = [number(body, 4 + 2 * i, 2, True) for i in range(4)]
        at += 8 + n
    if "width" not in out:
        raise ContainerError("no geometry")
    return out | {"offset": end, "size": out["width"] * out["height"] * out["bits"] // 8}


PARSERS = {"TIFF": tiff, "CIFF": ciff, "RAF": fiff}
ROWS = "file_id long, ifd string, dfs int, tag int, kind int, count long, value binary, big boolean, error string, number long"
#: Bytes of a whole number by its kind, and rows of a batch.
WHOLE, MOST_ROWS = {1: 1, 3: 2, 4: 4, 13: 4}, 5000


def kind_of(data: bytes) -> str:
    if data.startswith(b"FUJIFILM"):
        return "RAF"
    return "CIFF" if data[6:14] == b"HEAPCCDR" else "TIFF"


def entries(files: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """One row for each entry of each file, with the first of its whole numbers, if it has such; within a directory the last entry of a tag wins."""

    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int64())

    def whole(e: Entry) -> int | None:
        size = WHOLE.get(e.kind)
        return int.from_bytes(e.value[:size], "big" if e.big else "little") if size and len(e.value) >= size else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for file_id, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):  # a file at a time
                try:
                    raw = data.as_py() or b""
                    own = [(file_id, path, dfs, e.tag, e.kind, e.count, e.value, e.big, None, whole(e)) for dfs, (path, d) in enumerate(PARSERS[kind_of(raw)](raw).walk()) for e in d.last_wins()]
                except ContainerError as x:
                    own = [(file_id, None, None, None, None, None, None, None, str(x), None)]
                rows += own
                held += sum(len(r[6] or b"") for r in own)
                if len(rows) >= MOST_ROWS or held >= 1 << 24:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return files.selectExpr(f"{id_col} AS file_id", f"{content} AS content").mapInArrow(parsed, ROWS)


def written_tiff(directories: list[list[tuple[int, int, int, bytes]]], big: bool = False) -> bytes:
    """A TIFF file of directories of (tag, kind, count, value), one after the other."""
    e = ">" if big else "<"
    out = bytearray((b"MM" if big else b"II") + struct.pack(e + "HI", 42, 8))
    for i, entries in enumerate(directories):
        at = len(out)
        extra = at + 2 + 12 * len(entries) + 4
        table, tail = struct.pack(e + "H", len(entries)), b""
        for tag, kind, count, value in entries:
            place = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(e + "I", extra + len(tail))
            tail += value if len(value) > 4 else b""
            table += struct.pack(e + "HHI", tag, kind, count) + place
        following = extra + len(tail) if i + 1 < len(directories) else 0
        out += table + struct.pack(e + "I", following) + tail
    return bytes(out)
