"""Round trips, golden vectors and damaged data."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastrel.operators.codecs import adaptive, planes, predictive, prefix
from rastrel.operators.codecs.bits import WORDS, BitReader, BitWriter, CodecError, difference_bits, extended

CODE = prefix.flat_code(list(range(17)))


@pytest.mark.parametrize("order", sorted(WORDS))
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 32)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(order, parts):
    w = BitWriter(order)
    for v, n in parts:
        w.put(v, n)
    data = w.done()
    if order != "jpeg":
        assert len(data) % 4 == 0
    r = BitReader(data, order)
    assert [r.get(n) for _, n in parts] == [v & (1 << n) - 1 for v, n in parts]


def test_low_bits_come_first():
    r = BitReader(bytes([0x4B, 0x84, 0x20, 0xF0]), "lsb")
    assert [r.get(n) for n in range(1, 8)] == [1] * 7


def test_stuffed_bytes_and_the_end():
    assert BitReader(b"\xff\x00\xff\xd9\x12", "jpeg").get(16) == 0xFF00
    with pytest.raises(CodecError):
        BitReader(b"\x01").get(100)


@given(st.integers(-32767, 32767))
def test_differences(d):
    assert extended(*difference_bits(d)) == d


def test_prefix_vectors():
    code = prefix.PrefixCode([2], [4, 8], full=False)
    bits = BitReader(bytes([0b01010101] * 4))
    assert [code.value(bits) for _ in range(32)] == [4, 8] * 16
    code = prefix.PrefixCode([2], [7, 15])
    bits = BitReader(bytes([0b00000000, 0b11010101, 0b01010101, 0b01111111]))
    assert [code.difference(bits) for _ in range(3)] == [-127, 21845, 127]
    code = prefix.PrefixCode([1], [4], full=False)
    bits = BitReader(bytes([0b01000000]))
    assert code.value(bits) == 4
    with pytest.raises(CodecError):
        code.value(bits)
    code = prefix.PrefixCode([1], [1])
    bits = BitReader(bytes([0b00100000]))
    assert code.difference(bits) == -1


@pytest.mark.parametrize(("counts", "values"), [([], []), ([0], []), ([3], [1, 2, 3]), ([2, 1], [1, 2, 3]), ([1], [1, 2]), ([1], [17])])
def test_impossible_codes(counts, values):
    with pytest.raises(CodecError):
        prefix.PrefixCode(counts, values)


@pytest.fixture(params=range(3))
def smooth(request):
    r = np.random.default_rng(request.param)
    return np.clip(np.cumsum(r.integers(-60, 61, (10, 64)), axis=1) + 2000, 0, 4095)


def test_round_trips(smooth):
    h, w = smooth.shape
    assert (predictive.decode_rows(predictive.encode_rows(smooth, *CODE), w, h, *CODE) == smooth).all()
    assert (predictive.decode_v1(predictive.encode_v1(smooth), w, h) == smooth).all()
    assert (predictive.decode_pairs(predictive.encode_pairs(smooth, *CODE, start=100), w, h, *CODE, start=100) == smooth).all()
    assert (predictive.decode_columns(predictive.encode_columns(smooth), w, h) == smooth).all()
    assert (predictive.decode_segments(predictive.encode_segments(smooth), w, h) == smooth).all()
    assert (predictive.decode_strip(predictive.encode_strip(smooth[0]), w)[0] == smooth[0]).all()
    assert (adaptive.decode_gradient(adaptive.encode_gradient(smooth), w, h) == smooth).all()
    assert (adaptive.decode_groups(adaptive.encode_groups(smooth[0]), w, 1)[0] == smooth[0]).all()


@pytest.mark.parametrize(("parts", "restart"), [(1, 0), (2, 3), (4, 5), (3, 0)])
def test_frames(parts, restart):
    img = np.random.default_rng(parts).integers(0, 65536, (11, parts * 8))
    data = predictive.encode_frame(img, parts, *CODE, restart_rows=restart)
    assert (predictive.decode_frame(data, img.shape[1], 11) == img).all()
    assert (predictive.decode_frame(data, parts * 4, 7) == img[:7, : parts * 4]).all()
    with pytest.raises(CodecError):
        predictive.decode_frame(data, img.shape[1], 12)
    with pytest.raises(CodecError):
        predictive.decode_frame(data[2:], img.shape[1], 11)


@pytest.mark.parametrize("predictor", [3, 34894, 34895])
def test_float_planes(predictor):
    img = np.random.default_rng(2).normal(size=(6, 16)).astype("f4")
    assert (planes.decode_planes(planes.encode_planes(img, 32, predictor), 16, 6, 32, predictor) == img).all()
    half = img.astype("f2")
    assert (planes.decode_planes(planes.encode_planes(half, 16, predictor), 16, 6, 16, predictor) == half.astype(float)).all()
    with pytest.raises(CodecError):
        planes.decode_planes(b"nothing", 16, 6)
    with pytest.raises(CodecError):
        planes.decode_planes(planes.encode_planes(img), 16, 6, predictor=9)


def test_values_out_of_bounds():
    with pytest.raises(CodecError):
        predictive.decode_rows(predictive.encode_rows(np.array([[0, 70000 - 65536, 5000, 3]]), *CODE), 4, 1, *CODE, bits=12)


def test_code_headers():
    header = b"\x00\x00" + bytes(12) + b"".join(c.to_bytes(2, "big") for c in range(0, 12 * 256, 256)) + bytes([4] * 12)
    counts, order = predictive.code_from_header(header)
    assert counts[3] == 12 and sorted(order) == list(range(12))


def test_decoding_a_table_of_units(spark, smooth):
    from rastrel.operators.codecs import decoded

    units = [(1, predictive.encode_v1(smooth), 64, 10), (2, b"\x00", 64, 10), (3, None, 64, 10)]
    out = decoded(spark.createDataFrame(units, "unit_id long, data binary, width int, height int"), "v1").collect()
    assert np.array([r.v for r in sorted(out, key=lambda r: r.y or 0) if r.unit_id == 1]).tolist() == smooth.tolist()
    assert {r.unit_id for r in out if r.error} == {2, 3}


def test_blocks_and_slices():
    r = np.random.default_rng(4)
    img = np.clip(np.cumsum(r.integers(-9, 10, (16, 64)), axis=1) + 512, 0, 1023)
    code = prefix.flat_code([*range(16), 255])
    data = adaptive.encode_blocks(img, code, code)
    assert (adaptive.decode_blocks(data, 64, 16, code, code) == img).all()
    low = r.integers(0, 256, 16 * 16, dtype=np.uint8)
    assert (adaptive.decode_blocks(data, 64, 16, code, code, low.tobytes()) >> 2 == img).all()
    wide = r.integers(0, 65536, (8, 30))
    assert (predictive.decode_sliced(predictive.encode_sliced(wide, 2, 10, [12, 12, 6], *CODE), 30, 8, [12, 12, 6]) == wide).all()
    with pytest.raises(CodecError):
        predictive.sliced(np.arange(10), 3, 3, [3])


def test_scaled_packets():
    # two first values of 12 bits, then unchanged ones: a scale before every third sample
    bits = "0" * 0 + f"{0x12:08b}{0x3:04b}{0x45:08b}{0x6:04b}"
    for i in range(2, 14):
        bits += ("00" if i % 3 == 2 else "") + "0" * 8
    packet = int(bits[:128].ljust(128, "0"), 2).to_bytes(16, "little")
    img = adaptive.decode_scaled(packet, 14, 1)
    assert img.tolist() == [[0x123, 0x456] * 7]
    assert (adaptive.decode_scaled((packet * 1024)[8:] + (packet * 1024)[:8], 14, 1024, split=16384 - 8) == img).all()
    assert adaptive.zero_samples(adaptive.decode_scaled(bytes(16), 14, 1))[0] == (0, 0)


def test_keystreams():
    from rastrel.functions import keystreams

    data = bytes(range(64))
    assert keystreams.xored(keystreams.xored(data, 12345), 12345) == data != keystreams.xored(data, 12345)


def plain_packets(data, bits):
    """Packets of 16 bytes, a sample at a time, by text of bits."""
    n, wide, short, base, limit, top = adaptive.PACKET[bits]
    out = []
    for k in range(0, len(data), 16):
        text = "".join(f"{b:08b}" for b in reversed(data[k : k + 16]))
        at, seen, last, scale = 0, [False, False], [0, 0], 0
        for i in range(n):
            if i % 3 == 2:
                scale, at = [1, 2, 4, 16][int(text[at : at + 2], 2)], at + 2
            size = wide if i < 2 else short
            v, at = int(text[at : at + size], 2), at + size
            lane = i & 1
            if seen[lane]:
                v = v * scale % 65536
                if base * scale < limit and last[lane] > base * scale:
                    v = (v + last[lane] - base * scale) % 65536
                last[lane] = v
            elif v:
                seen[lane], last[lane] = True, v
            out.append(min(top, max(0, last[lane] - 15)))
    return out


@pytest.mark.parametrize("bits", [12, 14])
def test_packets_equal_a_plain_loop(bits):
    r = np.random.default_rng(bits)
    n = adaptive.PACKET[bits][0]
    data = r.integers(0, 256, 16 * 200, dtype=np.uint8)
    data[::3] &= r.integers(0, 2, len(data[::3]), dtype=np.uint8) * 255  # zeros, so that first values are late
    assert adaptive.decode_packets(data.tobytes(), n * 10, 20, bits).ravel().tolist() == plain_packets(data.tobytes(), bits)
    with pytest.raises(CodecError):
        adaptive.decode_packets(data.tobytes()[:-1], n * 10, 20, bits)


def test_scaled_packets_equal_a_plain_loop():
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 16 * 300, dtype=np.uint8) * (r.random(16 * 300) < 0.7).astype(np.uint8)
    want = []
    for k in range(0, len(data), 16):
        text, at = "".join(f"{b:08b}" for b in data[k : k + 16][::-1].tolist()) + "0" * 32, 0
        value, known, shift = [0, 0], [False, False], 0
        for i in range(14):
            if i % 3 == 2:
                shift, at = [0, 1, 2, 4][int(text[at : at + 2], 2)], at + 2
            byte, at = int(text[at : at + 8], 2), at + 8
            if known[i % 2]:
                if byte:
                    v = value[i % 2] - 128 * 2**shift
                    value[i % 2] = (v % 2**shift if v < 0 or shift == 4 else v) + byte * 2**shift
            elif byte or i > 11:
                value[i % 2], at, known[i % 2] = byte * 16 + int(text[at : at + 4], 2), at + 4, byte > 0
            want.append(value[i % 2])
    assert adaptive.decode_scaled(data.tobytes(), 14 * 30, 10).ravel().tolist() == want


def test_strips_of_fixed_bytes():
    """Lengths 8 and 7 for the lanes, then eight differences and two samples as they are; bits written by hand."""
    bits = "010" + "011" + "10000000" + "1000000" + "10000001" + "0111111" + "01111111" + "1000000" + "11111111" + "0000000" + f"{1000:016b}{2000:016b}"
    raw = int(bits.ljust(-(-len(bits) // 32) * 32, "0"), 2).to_bytes(-(-len(bits) // 32) * 4, "big")
    data = b"".join(raw[i : i + 4][::-1] for i in range(0, len(raw), 4))
    assert predictive.decode_strip(data, 10).tolist() == [[1, 1, 3, 1, 3, 2, 131, 65536 - 61, 1000, 2000]]


@pytest.mark.parametrize("name", ["prefix_frames", "adaptive_lengths", "gradient", "packets14", "scaled_packets", "float_planes", "v1", "columns"])
def test_damaged_bytes_are_rows_with_errors(spark, name):
    from rastrel.operators.codecs import decoded

    r = np.random.default_rng(6)
    frame = predictive.encode_frame(r.integers(0, 65536, (8, 28)), parts=2, counts=CODE[0], values=CODE[1])
    units = [(i, bytes(x)) for i in range(60) for x in [bytearray(frame if i % 2 else r.integers(0, 256, 300, dtype=np.uint8).tobytes())]]
    hurt = []
    for i, data in units:
        own = bytearray(data)
        for _ in range(i % 7):
            own[r.integers(len(own))] = r.integers(256)
        hurt.append((i, bytes(own[: r.integers(1, len(own))])))
    df = spark.createDataFrame([*hurt, (100, None), (101, b"")], "unit_id long, data binary").selectExpr("*", "28 AS width", "8 AS height")
    got = decoded(df, name).groupBy("unit_id").agg({"y": "max", "error": "max"}).collect()
    assert len(got) == 62 and all((x["max(y)"] is None) == (x["max(error)"] is not None) for x in got)

