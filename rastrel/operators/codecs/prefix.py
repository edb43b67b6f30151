"""Canonical prefix codes: symbols of values by code length, decoded through a dictionary of (length, code)."""

from __future__ import annotations

from .bits import BitReader, BitWriter, CodecError, difference_bits, extended

LONGEST, MOST_VALUES, MOST_BITS = 16, 162, 16


class PrefixCode:
    """counts: codes of length 1, 2, ...; values: theirs, in order. full: values are lengths of differences, 16 bits at most."""

    def __init__(self, counts: list[int], values: list[int], full: bool = True, bug16: bool = False):
        while counts and not counts[-1]:
            counts = counts[:-1]
        if not counts or len(counts) > LONGEST:
            raise CodecError("no code lengths")
        if sum(counts) > MOST_VALUES or sum(counts) != len(values):
            raise CodecError("wrong number of code values")
        free = 1
        self.symbols: dict[tuple[int, int], int] = {}
        code, left = 0, iter(values)
        for length, n in enumerate(counts, 1):
            free *= 2
            if n > free:
                raise CodecError(f"{n} codes of {length} bits can't fit")
            free -= n
            code <<= 1
            for _ in range(n):
                self.symbols[length, code] = next(left)
                code += 1
        if full and any(v > MOST_BITS for v in values):
            raise CodecError("a difference has 16 bits at most")
        self.codes = {v: k for k, v in self.symbols.items()}
        self.longest, self.bug16 = len(counts), bug16
        # one table over the longest code: what every first bits mean
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.longest)
        for (length, code), v in self.symbols.items():
            spare = self.longest - length
            self.table[code << spare : code + 1 << spare] = [(length, v)] * (1 << spare)

    def value(self, bits: BitReader) -> int:
        hit = self.table[bits.peek(self.longest)]
        if hit is None:
            raise CodecError("a bad code")
        bits.skip(hit[0])
        return hit[1]

    def difference(self, bits: BitReader) -> int:
        n = self.value(bits)
        if n == 16:
            if self.bug16:
                bits.skip(16)
            return -32768
        return extended(bits.get(n), n)

    def put_value(self, out: BitWriter, v: int) -> None:
        if v not in self.codes:
            raise CodecError(f"no code for {v}")
        length, code = self.codes[v]
        out.put(code, length)

    def put_difference(self, out: BitWriter, d: int) -> None:
        if d == -32768:
            self.put_value(out, 16)
            if self.bug16:
                out.put(0, 16)
            return
        code, n = difference_bits(d)
        self.put_value(out, n)
        out.put(code, n)


def code_of(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """(counts, values) of a code with so many bits for each value."""
    order = sorted(lengths, key=lambda v: (lengths[v], v))
    counts = [0] * max(lengths.values())
    for v in order:
        counts[lengths[v] - 1] += 1
    return counts, order


def flat_code(values: list[int]) -> tuple[list[int], list[int]]:
    """A code of equal lengths, not all of whose codes are used."""
    n = max(1, len(values).bit_length())
    return [0] * (n - 1) + [len(values)], list(values)
