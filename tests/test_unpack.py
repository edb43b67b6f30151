"""Samples of packed bytes against plain loops over text of bits."""

import numpy as np
import pytest

from rastrel.operators import unpack
from rastrel.operators.codecs import adaptive


def plain(row, layout):
    """A row's samples, from its bits as text."""
    row = row + bytes(16)
    if layout.order == "lsb":
        text = "".join(f"{b:08b}"[::-1] for b in row)
        return [int(text[s : s + layout.bits][::-1], 2) for s in layout.starts]
    w = {"msb": 1, "msb16": 2, "msb32": 4}[layout.order]
    text = "".join(f"{b:08b}" for i in range(0, len(row), w) for b in row[i : i + w][::-1])
    return [int(text[s : s + layout.bits], 2) for s in layout.starts]


LAYOUTS = [unpack.packed(n, bits, order, start) for order in ("lsb", "msb", "msb16", "msb32") for n, bits, start in ((32, 12, 0), (38, 10, 0), (27, 14, 3), (16, 24, 0), (48, 8, 0), (400, 1, 0))]
LAYOUTS += [unpack.with_control(30), unpack.with_control(30, False), unpack.left_aligned(24), unpack.left_aligned(24, True), unpack.packets(27), unpack.packets(30, 12)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    rows = np.random.default_rng(3).integers(0, 256, (50, 48), dtype=np.uint8)
    assert layout.taken(rows).tolist() == [plain(r.tobytes(), layout) for r in rows]


def test_samples_of_a_table(spark, monkeypatch):
    """Chunks that end within a text, bytes behind whole lines, empty and missing texts."""
    monkeypatch.setattr(unpack, "CHUNK", 20)
    r = np.random.default_rng(4)
    texts = [(i, None if i == 3 else r.integers(0, 256, n, dtype=np.uint8).tobytes()) for i, n in enumerate((0, 47, 48, 48, 500, 96, 5))]
    layout = unpack.packed(4, 12)
    got = unpack.samples(spark.createDataFrame(texts, "id long, data binary"), layout.taken, 48).collect()
    want = [(i, y, x, v) for i, d in texts for y in range(len(d or b"") // 48) for x, v in enumerate(plain(d[y * 48 : y * 48 + 48], layout))]
    assert sorted(map(tuple, got)) == want


def test_packets_of_many_texts_are_decoded_together(spark):
    """2,000 texts are some Arrow batches, not 2,000 calls."""
    calls, data = spark.sparkContext.accumulator(0), np.random.default_rng(5).integers(0, 256, 64, dtype=np.uint8).tobytes()

    def taken(rows):
        calls.add(1)
        return adaptive.decode_scaled(rows.tobytes(), 14, len(rows))

    out = unpack.samples(spark.createDataFrame([(i, data) for i in range(2000)], "id long, data binary").repartition(2), taken, 16)
    assert out.filter("id = 77").select("y", "x", "v").collect() == [(y, x, v) for y, line in enumerate(adaptive.decode_scaled(data, 14, 4).tolist()) for x, v in enumerate(line)]
    assert 0 < calls.value <= 20


def test_extremes_that_share_a_place():
    """Where greatest and least share a place the last step begins behind the packet, and lies in the next one or is zero."""
    rows = np.random.default_rng(6).integers(0, 256, (300, 48), dtype=np.uint8)
    for row, got in zip(rows, unpack.extremes_and_deltas(rows), strict=True):
        whole, want = int.from_bytes(row.tobytes(), "little"), []
        for p in range(3):
            at = lambda first, n, p=p: whole >> 128 * p + first & (1 << n) - 1
            hi, lo, ihi, ilo = at(0, 11), at(11, 11), at(22, 4), at(26, 4)
            scale, j = sum(0x80 << s <= hi - lo for s in range(4)), 0
            for k in range(16):
                if k not in (ihi, ilo):
                    want.append(2 * min(0x7FF, (at(30 + 7 * j, 7) << scale) + lo))
                    j += 1
                else:
                    want.append(2 * (hi if k == ihi else lo))
        assert got.tolist() == want
