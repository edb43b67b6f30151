"""Codecs whose code lengths depend on what came before.

Where lengths depend on the differences alone, these are read first, as numbers in stream order; the samples follow from
arrays of them. Packets are independent, so they are decoded together: a step of all packets at a time.
"""

from __future__ import annotations

import numpy as np

from .bits import BitReader, BitWriter, CodecError, difference_bits, extended
from .prefix import PrefixCode

U16 = 0xFFFF

# two lanes a row, each with a length that follows its last difference

#: Bits of the unary part, of the stored number, and the size up to which a difference is small.
UNARY, LONG, SMALL = 12, 15, 16


def lane_bits(size: int, smalls: int) -> int:
    """Bits that a lane stores as they are, after a difference of this size and so many small ones in a row."""
    extra = 0 if smalls > 2 else 2
    return max(2 + extra, size.bit_length() - extra)


def lane_after(state: tuple[int, int, int], magnitude: int, negative: bool) -> tuple[int, tuple[int, int, int]]:
    """(the upper part of the difference, the lane's state after it); a state is the last size, a running mean and the number of small sizes in a row."""
    _, mean, smalls = state
    upper = (-1 - magnitude if negative else magnitude) + mean
    return upper, (magnitude, (3 * upper + mean) >> 5, smalls + 1 if magnitude <= SMALL else 0)


def lane_differences(stream: BitReader, width: int, height: int) -> np.ndarray:
    """All differences of an image of two lanes a row, which need no sample to be read."""
    out = np.zeros(width * height, np.int64)
    for row in range(height):
        states = [(0, 0, 0)] * 2
        for k in range(row * width, (row + 1) * width):
            own = states[(k - row * width) & 1]
            stored = lane_bits(own[0], own[2])
            head = stream.get(3)
            zeros = UNARY - stream.peek(UNARY).bit_length()
            stream.skip(min(zeros + 1, UNARY))
            upper = zeros
            if zeros == UNARY:
                upper = stream.get(LONG - stored + 1) >> 1
            d, states[(k - row * width) & 1] = lane_after(own, upper << stored | stream.get(stored), head > 3)
            out[k] = 4 * d + (head & 3)
    return out.reshape(height, width)


def predicted(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour across the smaller step; where both steps go opposite ways, their plane, or for small ones their mean."""
    across, down = left - corner, up - corner
    opposite, far = across * down < 0, np.maximum(abs(across), abs(down)) > 32
    return np.select([opposite & far, opposite, abs(across) > abs(down)], [left + down, (left + up) >> 1, left], up)


def summed(d: np.ndarray) -> np.ndarray:
    """Samples of one plane out of its differences. The first row and column are running sums; all others lie on diagonals whose samples depend on earlier diagonals only."""
    rows, cols = d.shape
    out = np.zeros_like(d)
    out[:1], out[:, :1] = np.cumsum(d[:1], axis=1) & U16, np.cumsum(d[:, :1], axis=0) & U16
    for k in range(2, rows + cols - 1):
        i = np.arange(max(1, k - cols + 1), min(rows, k))
        j = k - i
        out[i, j] = predicted(out[i, j - 1], out[i - 1, j], out[i - 1, j - 1]) + d[i, j] & U16
    return out


def decode_gradient(data: bytes, width: int, height: int, skip: int = 7) -> np.ndarray:
    """Sign, two low bits, zeros that count the high part (12: it follows), and as many bits as the lane's state says; samples of the same place in 2 x 2 are a plane each."""
    d = lane_differences(BitReader(data[skip:]), width, height)
    out = np.zeros_like(d)
    for y in (0, 1):
        for x in (0, 1):
            out[y::2, x::2] = summed(d[y::2, x::2])
    return out


def encode_gradient(img: np.ndarray, skip: int = 7) -> bytes:
    d = img.copy()
    for y in (0, 1):
        for x in (0, 1):
            plane, own = img[y::2, x::2], d[y::2, x::2]
            own[:1, 1:] -= plane[:1, :-1]
            own[1:, :1] -= plane[:-1, :1]
            own[1:, 1:] -= predicted(plane[1:, :-1], plane[:-1, 1:], plane[:-1, :-1])
    out = BitWriter()
    for row in d.tolist():
        states = [(0, 0, 0)] * 2
        for k, v in enumerate(row):
            own = states[k & 1]
            stored, rest = lane_bits(own[0], own[2]), (v >> 2) - own[1]
            magnitude = -1 - rest if rest < 0 else rest
            out.put((rest < 0) << 2 | v & 3, 3)
            upper = magnitude >> stored
            if upper < UNARY:
                out.put(1, upper + 1)
            else:
                out.put(0, UNARY)
                out.put(upper << 1, LONG - stored + 1)
            out.put(magnitude, stored)
            states[k & 1] = lane_after(own, magnitude, rest < 0)[1]
    return bytes(skip) + out.done()


def signed(v: int, n: int) -> int:
    return v - (1 << n) if n and v >> n - 1 else v


def decode_groups(data: bytes, width: int, height: int, above: np.ndarray | None = None, row: int = 0) -> np.ndarray:
    """One row in groups of 16: a direction, four changes of lengths (none, one more, one less, a new one), then even and odd samples.

    above: the two rows before, for groups that predict from them.
    """
    stream, out = BitReader(data, "msb32"), np.zeros(width, np.int64)
    lengths = [7 if row < 2 else 4] * 4
    for x in range(0, width, 16):
        upward = stream.get(1)
        for i, op in enumerate([stream.get(2) for _ in range(4)]):
            lengths[i] = stream.get(4) if op == 3 else lengths[i] + (0, 1, -1)[op]
            if not 0 <= lengths[i] <= 16:
                raise CodecError("a length is out of bounds")
        if upward and (row < 2 or above is None or x + 16 >= width):
            raise CodecError("a group can't be predicted from above here")
        for odd in (0, 1):
            start = int(out[x - 2 + odd]) if x else 128
            for c in range(odd, 16, 2):
                n = lengths[2 * odd + c // 8]
                d = signed(stream.get(n), n)
                if x + c < width:
                    out[x + c] = d + (int(above[-1 - odd, x + c]) if upward else start) & U16
    return out.reshape(1, -1)


def encode_groups(values: np.ndarray, row: int = 0) -> bytes:
    """As decode_groups(), all groups from the left, with new lengths each time."""
    out, v = BitWriter("msb32"), values.tolist()
    for x in range(0, len(v), 16):
        diffs = {c: v[x + c] - (v[x - 2 + c % 2] if x else 128) for c in range(16)}
        lengths = [max(0 if not (d := diffs[c]) else (d if d > 0 else ~d).bit_length() + 1 for c in range(odd, 16, 2) if c // 8 == half) for odd in (0, 1) for half in (0, 1)]
        if max(lengths) > 15:
            raise CodecError("a difference is too large for a new length")
        out.put(0, 1)
        out.put(0b11111111, 8)
        for n in lengths:
            out.put(n, 4)
        for odd in (0, 1):
            for c in range(odd, 16, 2):
                n = lengths[2 * odd + c // 8]
                out.put(diffs[c], n)
    return out.done()


#: Fixed values by bits of a sample: samples of a packet of 16 bytes, widths of its fields in the order of reading from the top, the base and its limit.
PACKET = {14: (11, 14, 10, 0x200, 0x2000, 0x3FFF), 12: (14, 12, 8, 0x80, 0x800, 0xFFF)}


def packet_rows(data: bytes, n: int) -> np.ndarray:
    """n packets of 16 bytes as rows, last byte first, and zeros to read beyond them."""
    if len(data) < 16 * n:
        raise CodecError("not enough whole packets")
    rows = np.frombuffer(data, np.uint8, 16 * n).reshape(n, 16)[:, ::-1]
    return np.pad(rows, ((0, 0), (0, 16))).astype(np.int64)


def taken(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n bits (16 at most) of each packet, from its own place on."""
    k, first = np.arange(len(rows)), at >> 3
    three = rows[k, first] << 16 | rows[k, first + 1] << 8 | rows[k, first + 2]
    return three >> (24 - n - (at & 7)) & (1 << n) - 1


def packet_fields(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples as they are stored, the scale that holds for each) of packets, a column each: two wide samples, then groups of a scale and three short ones."""
    n, wide, short, *_ = PACKET[bits]
    at, samples, scales, scale = np.zeros(len(rows), np.int64), [], [], np.zeros(len(rows), np.int64)
    for i in range(n):
        if i % 3 == 2:
            scale = np.array([1, 2, 4, 16])[taken(rows, at, 2)]
            at = at + 2
        width = wide if i < 2 else short
        samples.append(taken(rows, at, width))
        scales.append(scale)
        at = at + width
    return np.stack(samples, axis=1), np.stack(scales, axis=1)


def decode_packets(data: bytes, width: int, height: int, bits: int = 14) -> np.ndarray:
    """Packets of 16 bytes, each on its own: absolute first values of both lanes, then scaled steps around the last ones."""
    n, _, _, base, limit, top = PACKET[bits]
    if width % n:
        raise CodecError("not enough whole packets")
    stored, scales = packet_fields(packet_rows(data, width * height // n), bits)
    out = np.zeros_like(stored)
    for lane in (0, 1):
        began, last = np.zeros(len(stored), bool), np.zeros(len(stored), np.int64)
        for i in range(lane, n, 2):
            v, scale = stored[:, i], scales[:, i]
            floor = base * scale
            step = v * scale & U16
            step = np.where((floor < limit) & (last > floor), step + last - floor & U16, step)
            last = np.where(began, step, np.where(v > 0, v, last))
            began |= v > 0
            out[:, i] = last
    return np.clip(out - 15, 0, top).reshape(height, width)


#: Samples of a packet of 16 bytes, and bytes of a block whose two sections may be stored the other way round.
SCALED, BLOCK = 14, 0x4000
SHIFTS = np.array([0, 1, 2, 4])


def decode_scaled(data: bytes, width: int, height: int, split: int = 0) -> np.ndarray:
    """Packets of 14 samples in two lanes, read from their last bit down: first values of 12 bits, then bytes around the last value, scaled anew for every third sample. split: bytes of the section that is stored first but belongs last."""
    if split:
        data = b"".join(b[split:] + b[:split] for b in (data[i : i + BLOCK] for i in range(0, len(data), BLOCK)))
    if width * height % SCALED:
        raise CodecError("not enough whole packets")
    n = width * height // SCALED
    if len(data) < 16 * n:
        raise CodecError("not enough whole packets")
    # a packet is two numbers of 64 bits whose upper bits come next
    low, high = np.ascontiguousarray(np.frombuffer(data, "<u8", 2 * n).reshape(n, 2).T)
    shift, value, known = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros((2, n), bool)
    out = np.empty((SCALED, n), np.int64)
    for i in range(SCALED):
        if i % 3 == 2:
            shift = SHIFTS[high >> 62]
            high, low = high << 2 | low >> 62, low << 2
        lane = i % 2
        byte = (high >> 56).astype(np.int64)
        high, low = high << 8 | low >> 56, low << 8
        # a lane that has a value takes a step, unless it is zero; one without reads four more bits of its first, and at the end of none too
        below = value[lane] - (0x80 << shift)
        stepped = np.where((below < 0) | (shift == 4), below & (1 << shift) - 1, below) + (byte << shift)
        after = np.where(known[lane] & (byte > 0), stepped, value[lane])
        first = ~known[lane] & ((byte > 0) | (i > 11))
        if first.any():
            after = np.where(first, byte << 4 | (high >> 60).astype(np.int64), after)
            high, low = np.where(first, high << 4 | low >> 60, high), np.where(first, low << 4, low)
        known[lane] |= byte > 0
        value[lane] = out[i] = after
    return out.T.reshape(height, width)


def zero_samples(img: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) of samples that count as bad where zero isn't a value."""
    return [(int(x), int(y)) for y, x in np.argwhere(img == 0)]


def decode_blocks(data: bytes, width: int, height: int, first: tuple[list[int], list[int]], rest: tuple[list[int], list[int]], low: bytes | None = None) -> np.ndarray:
    """Blocks of 64 differences: run and length in one code value, the first of a block added to that of the block before; two lanes in a row from 512 on, 10 bits. low: two more bits of each sample, four in a byte."""
    if width % 4 or width * height % 64:
        raise CodecError("not a whole number of blocks")
    codes, stream = (PrefixCode(*first, full=False), PrefixCode(*rest, full=False)), BitReader(data, "jpeg")
    diffs = np.zeros((width * height // 64, 64), np.int64)
    for block in diffs:
        i = 0
        while i < 64:
            run, n = divmod(codes[i > 0].value(stream), 16)
            if (run, n) == (0, 0) and i:
                break
            if (run, n) == (15, 15):
                i += 1
                continue
            i += run
            d = extended(stream.get(n), n) if n else 0
            if n and i >= 64:
                break
            if n:
                block[i] = d
            i += 1
    diffs[:, 0] = np.cumsum(diffs[:, 0])
    img = np.cumsum(diffs.reshape(height, width // 2, 2), axis=1).reshape(height, width) + 512
    if ((img < 0) | (img > 1023)).any():
        raise CodecError("a value is out of bounds")
    if low is not None:
        extra = np.frombuffer(low[: width * height // 4], np.uint8).reshape(height, -1, 1) >> np.array([0, 2, 4, 6], np.uint8) & 3
        img = img << 2 | extra.reshape(height, width)
        img = np.where((width == 2672) & (img < 512), img + 2, img)
    return img


def encode_blocks(img: np.ndarray, first: tuple[list[int], list[int]], rest: tuple[list[int], list[int]]) -> bytes:
    """As decode_blocks(), without low bits and without runs."""
    codes, out = (PrefixCode(*first, full=False), PrefixCode(*rest, full=False)), BitWriter("jpeg")
    d = np.diff(img.astype(np.int64).reshape(img.shape[0], -1, 2) - 512, axis=1, prepend=0).reshape(-1, 64)
    d[:, 0] = np.diff(d[:, 0], prepend=0)
    for block in d.tolist():
        for i, v in enumerate(block):
            code, n = difference_bits(v)
            if n == 0 and i:  # a plain zero would end the block
                codes[1].put_value(out, 0xFF)
                continue
            codes[i > 0].put_value(out, n)
            out.put(code, n)
    return out.done()
