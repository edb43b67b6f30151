"""Codecs of differences: symbols first, then sums over lines."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from .bits import BitReader, BitWriter, CodecError, difference_bits, extended, unstuffed
from .prefix import PrefixCode

U16 = 0xFFFF


def in_range(img: np.ndarray, bits: int) -> np.ndarray:
    if ((img < 0) | (img >> bits != 0)).any():
        y, x = np.argwhere((img < 0) | (img >> bits != 0))[0]
        raise CodecError(f"a value is out of bounds at {x}, {y}")
    return img


def lanes_summed(diffs: np.ndarray, lanes: int) -> np.ndarray:
    """Running sums of every other (or so many-th) column and row: rows start from the first samples of the row as many lines above."""
    h, w = diffs.shape
    d = diffs.astype(np.int64).copy()
    for r in range(min(lanes, h)):
        d[r::lanes, :lanes] = np.cumsum(d[r::lanes, :lanes], axis=0)
    for c in range(min(lanes, w)):
        d[:, c::lanes] = np.cumsum(d[:, c::lanes], axis=1)
    return d


def lanes_differenced(img: np.ndarray, lanes: int) -> np.ndarray:
    """The inverse of lanes_summed()."""
    d = img.astype(np.int64).copy()
    d[:, lanes:] -= img[:, :-lanes]
    d[lanes:, :lanes] -= img[:-lanes, :lanes]
    return d


def walked(n: int, step: Callable[[], int]) -> np.ndarray:
    return np.fromiter((step() for _ in range(n)), np.int64, n)


# differences of two lanes in each direction; checked against a number of bits


def decode_rows(data: bytes, width: int, height: int, counts: list[int], values: list[int], bits: int = 16, lanes: int = 2) -> np.ndarray:
    """One prefix code for all differences, high bits first."""
    code, stream = PrefixCode(counts, values), BitReader(data)
    return in_range(lanes_summed(walked(width * height, lambda: code.difference(stream)).reshape(height, width), lanes), bits)


def encode_rows(img: np.ndarray, counts: list[int], values: list[int], lanes: int = 2) -> bytes:
    code, out = PrefixCode(counts, values), BitWriter()
    for d in lanes_differenced(img, lanes).ravel().tolist():
        code.put_difference(out, d)
    return out.done()


def code_from_header(data: bytes) -> tuple[list[int], list[int]]:
    """(counts, values) of a header: a 16-bit number of codes less 12, 12 bytes, then 16-bit left-aligned codes and their lengths.

    Values order by code; of equal codes the last comes first.
    """
    n = struct.unpack_from(">H", data)[0] + 12
    if n > 15:
        raise CodecError(f"{n} codes are too many")
    codes, lengths = struct.unpack_from(f">{n}H", data, 14), data[14 + 2 * n : 14 + 3 * n]
    if len(lengths) < n or any(not 1 <= x <= 12 for x in lengths):
        raise CodecError("code lengths are 1 to 12")
    order = sorted(range(n), key=lambda i: (codes[i] >> 12 - lengths[i], -i))
    counts = [sum(x == k for x in lengths) for k in range(1, 17)]
    return counts, order


#: Fixed values: (bits of the code, bits of the difference), in the order of the codes.
V1_CODE = ((3, 4), (3, 7), (2, 6), (2, 5), (4, 3), (6, 0), (7, 9), (8, 10), (9, 11), (10, 12), (10, 13), (5, 1), (4, 8), (4, 2))


def v1_table() -> list[tuple[int, int]]:
    """What each ten bits mean, as the codes fill the space in order."""
    return [entry for entry in V1_CODE for _ in range(1 << 10 - entry[0])]


def decode_v1(data: bytes, width: int, height: int, bits: int = 12) -> np.ndarray:
    table, stream = v1_table(), BitReader(data)

    def step() -> int:
        used, n = table[stream.peek(10)]
        stream.skip(used)
        return extended(stream.get(n), n)

    return in_range(lanes_summed(walked(width * height, step).reshape(height, width), 2), bits)


def encode_v1(img: np.ndarray) -> bytes:
    starts, at = {}, 0
    for used, n in V1_CODE:
        starts[n] = (at >> 10 - used, used)
        at += 1 << 10 - used
    out = BitWriter()
    for d in lanes_differenced(img, 2).ravel().tolist():
        code, n = difference_bits(d)
        out.put(*starts[n])
        out.put(code, n)
    return out.done()


# frames of several components, with markers


def frame_header(data: bytes) -> dict:
    """Geometry, prefix codes and predictor of a lossless frame, and where its entropy-coded data begin."""
    if data[:2] != b"\xff\xd8":
        raise CodecError("no start of image")
    at, out = 2, {"codes": {}, "restart": 0}
    while True:
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise CodecError("a marker is missing")
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC3:
            bits, h, w, parts = struct.unpack_from(">BHHB", body)
            out |= {"bits": bits, "height": h, "width": w, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(parts)]}
        elif kind == 0xC4:
            while body:
                counts = list(body[1:17])
                total = sum(counts)
                if len(body) < 17 + total:
                    raise CodecError("a code table ends too early")
                out["codes"][body[0] & 15] = (counts, list(body[17 : 17 + total]))
                body = body[17 + total :]
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            out["tables"] = {body[1 + 2 * i]: body[2 + 2 * i] >> 4 for i in range(body[0])}
            out |= {"predictor": body[1 + 2 * body[0]], "data": at}
            return out
        elif kind in (0xC0, 0xC1, 0xC2, 0xDB, 0xD9):
            raise CodecError(f"marker {kind:02x} has no place in a lossless frame")


def decode_frame(data: bytes, width: int, height: int, bug16: bool = False) -> np.ndarray:
    """A lossless frame of predictor 1 and one to four components side by side; width and height are what is taken of it."""
    head = frame_header(data)
    n = len(head.get("parts", ()))
    if not 1 <= n <= 4 or head["predictor"] != 1:
        raise CodecError("only predictor 1 and one to four components")
    if any(p[1:] != (1, 1) for p in head["parts"]):
        raise CodecError("subsampled components")
    codes = [PrefixCode(*head["codes"][head["tables"][p[0]]], bug16=bug16) for p in head["parts"]]
    h, w = head["height"], head["width"]
    if height > h or width > w * n:
        raise CodecError("the frame is smaller than its tile")
    rows_each = h if not head["restart"] else head["restart"] // w
    if head["restart"] % w or rows_each < 1:
        raise CodecError("restarts within a row")
    at, rows = head["data"], []
    for k in range(-(-h // rows_each)):
        if k:
            if data[at : at + 2] != bytes([0xFF, 0xD0 + (k - 1) % 8]):
                raise CodecError("a restart marker is missing")
            at += 2
        raw, used = unstuffed(data[at:])
        stream = BitReader(raw)
        count = min(rows_each, h - k * rows_each)
        diffs = np.fromiter((codes[i % n].difference(stream) for i in range(count * w * n)), np.int64, count * w * n).reshape(count, w, n)
        diffs[0, 0] += 1 << head["bits"] - 1
        diffs[:, 0] = np.cumsum(diffs[:, 0], axis=0)  # a row starts from the first samples of the one above
        rows.append(np.cumsum(diffs, axis=1) & U16)
        at += used
    return np.concatenate(rows).reshape(h, w * n)[:height, :width]


def encode_frame(img: np.ndarray, parts: int, counts: list[int], values: list[int], bits: int = 16, restart_rows: int = 0) -> bytes:
    h, w = img.shape[0], img.shape[1] // parts
    code = PrefixCode(counts, values)
    sof = struct.pack(">BHHB", bits, h, w, parts) + b"".join(bytes([i, 0x11, 0]) for i in range(parts))
    dht = bytes([0]) + bytes(counts + [0] * (16 - len(counts))) + bytes(values)
    sos = bytes([parts]) + b"".join(bytes([i, 0]) for i in range(parts)) + bytes([1, 0, 0])
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xC4, dht) + segment(0xC3, sof) + (segment(0xDD, struct.pack(">H", restart_rows * w)) if restart_rows else b"") + segment(0xDA, sos)
    each = restart_rows or h
    for k, top in enumerate(range(0, h, each)):
        part = img[top : top + each].astype(np.int64).reshape(-1, w, parts)
        d = part.copy()
        d[:, 1:] -= part[:, :-1]
        d[1:, 0] -= part[:-1, 0]
        d[0, 0] -= 1 << bits - 1
        d = (d + 32768 & U16) - 32768
        stream = BitWriter("jpeg")
        for v in d.ravel().tolist():
            code.put_difference(stream, v)
        out += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + stream.done()
    return out + b"\xff\xd9"


def sliced(line: np.ndarray, width: int, height: int, widths: list[int]) -> np.ndarray:
    """Samples in order of vertical slices, each row by row, as an image."""
    if sum(widths) != width or len(line) != width * height:
        raise CodecError("the slices don't fill the image")
    cuts = np.cumsum([0, *widths]) * height
    return np.concatenate([line[a:b].reshape(height, -1) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)


def decode_sliced(data: bytes, width: int, height: int, widths: list[int]) -> np.ndarray:
    """A lossless frame whose samples, in its own order, fill vertical slices of these widths."""
    head = frame_header(data)
    w = head["width"] * len(head["parts"])
    return sliced(decode_frame(data, w, head["height"]).ravel(), width, height, widths)


def encode_sliced(img: np.ndarray, parts: int, frame_width: int, widths: list[int], counts: list[int], values: list[int]) -> bytes:
    edges = np.cumsum([0, *widths])
    line = np.concatenate([img[:, a:b].ravel() for a, b in zip(edges, edges[1:], strict=False)])
    return encode_frame(line.reshape(-1, frame_width * parts), parts, counts, values)


# two lengths, then two differences


def decode_pairs(data: bytes, width: int, height: int, counts: list[int], values: list[int], start: int = 0) -> np.ndarray:
    """Pairs of samples; each row starts anew, sums wrap to 16 bits, and a difference of 65535 stands for -32768."""
    code, stream = PrefixCode(counts, values), BitReader(data, "msb32")

    def pair() -> tuple[int, int]:
        lengths = code.value(stream), code.value(stream)
        return tuple(-32768 if (d := extended(stream.get(n), n)) == 65535 else d for n in lengths)

    diffs = np.array([pair() for _ in range(height * width // 2)], np.int64).reshape(height, width // 2, 2)
    return (np.cumsum(diffs, axis=1) + start & U16).reshape(height, width)


def encode_pairs(img: np.ndarray, counts: list[int], values: list[int], start: int = 0) -> bytes:
    code, out = PrefixCode(counts, values), BitWriter("msb32")
    p = img.astype(np.int64).reshape(img.shape[0], -1, 2)
    d = p - start
    d[:, 1:] = p[:, 1:] - p[:, :-1]
    d = (d + 32767 & U16) - 32767  # sums wrap: 16 bits are enough, and 65535 would mean another number
    for pair in d.reshape(-1, 2).tolist():
        cut = [difference_bits(x) for x in pair]
        for _, n in cut:
            code.put_value(out, n)
        for c, n in cut:
            out.put(c, n)
    return out.done()


# columns from right to left, even rows before odd ones


def column_order(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    ys = np.concatenate([np.arange(0, height, 2), np.arange(1, height, 2)])
    return np.tile(ys, width), np.repeat(np.arange(width)[::-1], height)


def decode_columns(data: bytes, width: int, height: int, bits: int = 12) -> np.ndarray:
    """One running sum through all columns. Two bits give a length from 1 to 4; a bit behind 3 makes it 0, zeros behind 4 count on, to 17."""
    stream = BitReader(data)

    def step() -> int:
        n = 4 - stream.get(2)
        if n == 3:
            n = 0 if stream.get(1) else 3
        elif n == 4:
            while n < 17 and not stream.get(1):
                n += 1
        return extended(stream.get(n), n)

    img = np.empty((height, width), np.int64)
    img[column_order(width, height)] = np.cumsum(walked(width * height, step))
    return in_range(img, bits)


def encode_columns(img: np.ndarray) -> bytes:
    out = BitWriter()
    line = img.astype(np.int64)[column_order(img.shape[1], img.shape[0])]
    for d in np.diff(line, prepend=0).tolist():
        code, n = difference_bits(d)
        if n in (0, 3):
            out.put(0b01, 2)
            out.put(n == 0, 1)
        elif n < 3:
            out.put(4 - n, 2)
        else:
            out.put(0, 2)
            out.put(1, n - 3)
        out.put(code, n)
    return out.done()


# segments of 256 samples: lengths in half bytes first, then differences


def decode_segments(data: bytes, width: int, height: int, bits: int = 12) -> np.ndarray:
    """Each segment has its lengths, two in a byte, then its differences, low bits first, in words of two swapped bytes."""
    at, rows = 0, []
    for _ in range(height):
        row = []
        for left in range(0, width, 256):
            n = min(256, width - left)
            head = np.frombuffer(data, np.uint8, n // 2, at) if at + n // 2 <= len(data) else None
            if head is None:
                raise CodecError("the data end too early")
            lengths = np.stack([head & 15, head >> 4], axis=1).ravel().tolist()
            at += n // 2
            need, first = sum(lengths), 2 if n & 7 == 4 else 0
            size = first + max(0, -(-(need - first * 8) // 32)) * 4 if need else first
            body = data[at : at + size]
            if len(body) < size:
                raise CodecError("the data end too early")
            at += size
            stream = BitReader(b"".join(body[i : i + 2][::-1] for i in range(0, size, 2)), "lsb")
            row.append(_lanes(np.array([extended(stream.get(k), k) for k in lengths], np.int64)))
        rows.append(np.concatenate(row))
    return in_range(np.stack(rows), bits)


def _lanes(d: np.ndarray) -> np.ndarray:
    d[0::2], d[1::2] = np.cumsum(d[0::2]), np.cumsum(d[1::2])
    return d


def encode_segments(img: np.ndarray) -> bytes:
    out = b""
    for row in img.astype(np.int64):
        for left in range(0, len(row), 256):
            part = row[left : left + 256]
            d = part.copy()
            d[2:] -= part[:-2]
            cut = [difference_bits(x) for x in d.tolist()]
            lengths = [n for _, n in cut]
            out += bytes(a | b << 4 for a, b in zip(lengths[::2], lengths[1::2], strict=True))
            stream = BitWriter("lsb")
            for c, n in cut:
                stream.put(c, n)
            first = 2 if len(part) & 7 == 4 else 0
            need = sum(lengths)
            size = first + max(0, -(-(need - first * 8) // 32)) * 4 if need else first
            body = (stream.done() + bytes(size))[:size]
            out += b"".join(body[i : i + 2][::-1] for i in range(0, size, 2))
    return out


# strips whose lengths change every eight samples

#: The lengths that a count of zeros (1 to 5) and one more bit select.
STRIP_LENGTHS = ((8, 7), (6, 9), (11, 10), (5, 12), (14, 13))


def strip_head(code: int) -> tuple[int | None, int]:
    """(a lane's new length, none if it keeps its own; bits used) by the next six bits."""
    zeros = min(5, 6 - code.bit_length())
    if not zeros:
        return None, 1
    used = zeros + (zeros < 5) + 1
    return STRIP_LENGTHS[zeros - 1][code >> 6 - used & 1], used


STRIP_HEADS = [strip_head(code) for code in range(64)]


def strip_codes(stream: BitReader, width: int) -> tuple[list[int], list[int]]:
    """(codes, their lengths) of a row: eight samples at a time under the lengths of both lanes, the rest as they are."""
    codes, lengths, now = [], [], (0, 0)
    for _ in range(width // 8):
        chosen = []
        for kept in now:
            length, used = STRIP_HEADS[stream.peek(6)]
            stream.skip(used)
            chosen.append(length or kept)
        now = tuple(chosen)
        if 0 in now:
            raise CodecError("the first lengths are missing")
        sizes = [16 if n == 14 else n for n in now] * 4
        whole, below = stream.get(sum(sizes)), sum(sizes)
        for n in sizes:
            below -= n
            codes.append(whole >> below & (1 << n) - 1)
        lengths += now * 4
    rest = width % 8
    return codes + [stream.get(16) for _ in range(rest)], lengths + [14] * rest


def decode_strip(data: bytes, width: int, height: int = 1) -> np.ndarray:
    """One row: two lanes, each with its own length; 14 means the sample itself, as do the last ones beyond a multiple of 8. A lane is a running sum that starts anew at each sample stored as it is."""
    codes, lengths = (np.array(x, np.int64) for x in strip_codes(BitReader(data, "msb32"), width))
    row = np.zeros(width, np.int64)
    for lane in (0, 1):
        code, n = codes[lane::2], lengths[lane::2]
        stored = n == 14
        upto = np.cumsum(np.where(stored, 0, code + 1 - (1 << n - 1)))
        start = np.maximum.accumulate(np.where(stored, np.arange(len(code)), -1))
        row[lane::2] = np.where(start < 0, upto, upto - upto[start] + code[start])
    return (row & U16)[None]


def encode_strip(row: np.ndarray) -> bytes:
    """As decode_strip(); lengths are chosen anew for every eight samples."""
    places = {n: (i + 1, b) for i, pair in enumerate(STRIP_LENGTHS) for b, n in enumerate(pair)}
    out, pred, v = BitWriter("msb32"), [0, 0], row.tolist()
    whole = len(v) - len(v) % 8
    for x in range(0, whole, 8):
        lengths = []
        for lane in (0, 1):
            own, last, need = v[x + lane : x + 8 : 2], pred[lane], 5
            for s in own:
                d = s - last
                while need < 14 and not 1 - (1 << need - 1) <= d <= 1 << need - 1:
                    need += 1
                last = s
            lengths.append(need)
            zeros, bit = places[need]
            out.put(0, zeros)
            if zeros < 5:
                out.put(1, 1)
            out.put(bit, 1)
        for i in range(8):
            n, s = lengths[i % 2], v[x + i]
            if n == 14:
                out.put(s, 16)
            else:
                out.put(s - pred[i % 2] - 1 + (1 << n - 1), n)
            pred[i % 2] = s
    for s in v[whole:]:
        out.put(s, 16)
    return out.done()
