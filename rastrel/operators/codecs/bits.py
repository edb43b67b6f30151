"""Bit streams in five orders, read and written.

lsb: low bits of each byte first. msb: high bits first; msb16 and msb32: the same over little-endian words of two and
four bytes. jpeg: as msb, where a byte FF stands for itself only before 00, and before anything else ends the data.
"""

from __future__ import annotations

WORDS = {"lsb": 1, "msb": 1, "msb16": 2, "msb32": 4, "jpeg": 1}
#: Bytes that may be read beyond the end, as zeros.
SLACK = 8


class CodecError(Exception):
    """Data that can't be decoded."""


def unstuffed(data: bytes) -> tuple[bytes, int]:
    """Entropy-coded bytes without their stuffing, and how many bytes of the source they took."""
    out, at = bytearray(), 0
    while (i := data.find(b"\xff", at)) >= 0:
        out += data[at:i]
        if data[i + 1 : i + 2] != b"\x00":
            return bytes(out), i
        out.append(0xFF)
        at = i + 2
    return bytes(out + data[at:]), len(data)


def in_stream_order(data: bytes, order: str) -> bytes:
    if order == "jpeg":
        return unstuffed(data)[0]
    n = WORDS[order]
    if n == 1:
        return data
    data += bytes(-len(data) % n)
    return b"".join(data[i : i + n][::-1] for i in range(0, len(data), n))


class BitReader:
    """Bits of data, taken from the front; a few zeros follow the end, then reading is an error."""

    def __init__(self, data: bytes, order: str = "msb"):
        self.low_first = order == "lsb"
        raw = in_stream_order(data, order)
        self.limit = (len(raw) + SLACK) * 8
        self.raw, self.at = raw + bytes(SLACK + 8), 0

    def peek(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.limit:
            raise CodecError("the bit stream ends too early")
        first, skip = divmod(self.at, 8)
        chunk = self.raw[first : first + (skip + n + 7) // 8]
        if self.low_first:
            return int.from_bytes(chunk, "little") >> skip & (1 << n) - 1
        return int.from_bytes(chunk, "big") >> len(chunk) * 8 - skip - n & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.at += n

    def get(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v

    def bytes_used(self) -> int:
        return -(-self.at // 8)


class BitWriter:
    """The inverse of BitReader; done() pads with zeros to four bytes."""

    def __init__(self, order: str = "msb"):
        self.order, self.parts = order, []

    def put(self, v: int, n: int) -> None:
        if n:
            self.parts.append((v & (1 << n) - 1, n))

    def done(self) -> bytes:
        total = sum(n for _, n in self.parts)
        size = -(-total // 32) * 4
        if self.order == "lsb":
            bits = "".join(f"{v:0{n}b}"[::-1] for v, n in self.parts).ljust(size * 8, "0")
            return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        bits = "".join(f"{v:0{n}b}" for v, n in self.parts).ljust(size * 8, "0")
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        if self.order == "jpeg":
            return raw.replace(b"\xff", b"\xff\x00")
        return in_stream_order(raw, self.order)


def extended(v: int, n: int) -> int:
    """A difference of n bits whose negative values are those without the top bit."""
    return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


def difference_bits(d: int) -> tuple[int, int]:
    """(code, bits) whose extended() value is d."""
    n = abs(d).bit_length()
    return (d if d >= 0 else d + (1 << n) - 1), n
