"""Truth tables and small differential tests of operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.functions import cfa, curves
from rastrel.operators import catalog, geometry, neighbours, opcodes
from rastrel.operators.geometry import Rect

BIG = 2**31 - 1
ISO = [(0, 0, 0, True, True), (100, 0, 200, False, False), (100, 99, 200, False, False), (100, 100, 200, True, False), (100, 160, 200, True, False), (100, 200, 200, True, False), (100, 201, 200, False, False), (100, BIG, 200, False, False), (100, 0, 0, False, False), (100, 99, 0, False, False), (100, 100, 0, True, False), (100, BIG, 0, True, False)]


def test_sensitivity_ranges(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ISO)], "i int, lo long, iso long, hi long, within boolean, plain boolean")
    got = df.select("i", catalog.iso_within(F.col("iso"), F.col("lo"), F.col("hi")).alias("w"), "within").collect()
    assert all(r.w == r.within for r in got)


def test_sensor_choice(spark):
    s = spark.createDataFrame([("a", "m", 1, 10, 20, 0, 0), ("b", "m", 1, 1, 2, 500, 600), ("c", "m", 1, 1, 9, 0, 0), ("c", "m", 2, 2, 9, 100, 200), ("c", "m", 3, 3, 9, 150, 0), ("d", "m", 1, 1, 9, 100, 200), ("d", "m", 2, 2, 9, 300, 400)], "make string, model string, ord long, black long, white long, iso_min long, iso_max long")
    shots = spark.createDataFrame([(" a\t", "m", 7), ("b", "m", 7), ("c", "m", 50), ("c", "m", 160), ("c", "m", 1000), ("d", "m", 250), ("x", "m", 1)], "make string, model string, iso long")
    got = {(r.make.strip(), r.iso): r.sensor and r.sensor.black for r in catalog.choose_sensor(shots, s).collect()}
    assert got == {("a", 7): 10, ("b", 7): 1, ("c", 50): 1, ("c", 160): 2, ("c", 1000): 3, ("d", 250): None, ("x", 1): None}


def test_ranges_overlap(spark):
    cases = [(a, a + n, b, b + m) for a in range(4) for b in range(4) for n in range(3) for m in range(3)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d int")
    for r in df.select("*", geometry.ranges_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).collect():
        first, second = sorted([(r.a, r.b), (r.c, r.d)])
        assert r.o == (first[0] == second[0] or second[0] < first[1])


def test_crops():
    assert geometry.relative_crop(1, 2, -3, 0, 100, 50) == Rect(1, 2, 96, 48)
    assert Rect(0, 0, 4, 4).overlap(Rect(2, 3, 9, 9)) == Rect(2, 3, 2, 1) and not Rect(0, 0, 2, 2).overlap(Rect(5, 5, 1, 1)).has_area()
    with pytest.raises(ValueError, match="no area"):
        geometry.sub_frame(None, Rect(0, 0, 0, 5), 9, 9)


def test_splines():
    assert curves.spline([(0, 0), (65535, 65535)]) == [(0.0, 1.0, 0.0, 0.0)]
    assert curves.spline([(0, 65535), (65535, 0)]) == [(65535.0, -1.0, 0.0, 0.0)]
    assert (curves.spline_table([(0, 0), (65535, 65535)]) == np.arange(65536)).all()
    t = curves.spline_table([(0, 0), (20000, 65535), (30000, 0), (65535, 65535)])
    assert t.min() == 0 and t.max() == 65535
    with pytest.raises(ValueError, match="rise"):
        curves.spline([(0, 0), (0, 1), (65535, 1)])


def test_curves():
    assert curves.knee_table([4, 8, 12, 16])[-1] == 16384
    g = curves.gamma_table(1 / 2.4, 12.92, 65535)
    assert g[0] == 0 and (np.diff(g) >= 0).all() and g[-1] == 65535


def test_patterns(spark):
    row = spark.range(1).select(*[cfa.bayer_phase(cfa.pattern([{"R": "RED", "G": "GREEN", "B": "BLUE"}[c] for c in p])).alias(p) for p in cfa.BAYER], cfa.bayer_phase(cfa.pattern(["RED"] * 4)).alias("none")).first()
    assert all(row[p] == p for p in cfa.BAYER) and row.none is None
    p = cfa.pattern(["RED", "GREEN", "GREEN", "BLUE"])
    moved = spark.range(1).select(cfa.packed_filter(p, 2, 2).alias("f"), cfa.packed_filter(cfa.shifted(p, 2, 2, 1, 0), 2, 2).alias("x"), cfa.packed_filter(cfa.shifted(p, 2, 2, 0, 1), 2, 2).alias("y"), cfa.shifted_filter(cfa.packed_filter(p, 2, 2), 1, 0).alias("sx"), cfa.shifted_filter(cfa.packed_filter(p, 2, 2), 0, 1).alias("sy")).first()
    assert moved.f == 0x94949494 and moved.x == moved.sx and moved.y == moved.sy


def brute_repair(v, bad, width):
    """The documented rule, sample by sample."""
    h, w = v.shape
    out = v.copy()
    for y, x in np.argwhere(bad):
        if x >= 32 * ((width + 15) // 32):
            continue
        vals, dist = [], []
        for dx, dy in ((-2, 0), (2, 0), (0, -2), (0, 2)):
            a, b, n, hit = x + dx, y + dy, 2, None
            while 0 <= a < w and 0 <= b < h:
                if not bad[b, a]:
                    hit = int(v[b, a])
                    break
                a, b, n = a + dx, b + dy, n + 2
            vals.append(hit)
            dist.append(n if hit is not None else 0)
        total, shift = 0, 7
        for i in (0, 2):
            span = dist[i] + dist[i + 1]
            if span:
                first = (span - dist[i]) * 256 // span if dist[i] else 0
                total += (vals[i] or 0) * first + (vals[i + 1] or 0) * (256 - first)
                shift += 1
        out[y, x] = min(65535, total >> shift)
    return out


@pytest.mark.parametrize(("width", "share"), [(20, 0.1), (40, 0.5)])
def test_repair_equals_a_loop(spark, width, share):
    r = np.random.default_rng(width)
    v, bad = r.integers(0, 65536, (14, width)), r.random((14, width)) < share
    rows = [(0, y, x, int(v[y, x]), bool(bad[y, x])) for y in range(14) for x in range(width)]
    got = neighbours.repaired_u16(spark.createDataFrame(rows, "image_id long, y long, x long, v long, bad boolean"), width).collect()
    img = np.zeros_like(v)
    for p in got:
        img[p.y, p.x] = p.v
    assert (img == brute_repair(v, bad, width)).all()


def test_opcode_lists(spark):
    df = spark.createDataFrame([(0, y, x, 100) for y in range(4) for x in range(4)], "image_id long, y long, x long, v long")
    O = opcodes.Opcode
    with pytest.raises(ValueError, match="unknown"):
        opcodes.applied(df, [O(77)], 4, 4)
    with pytest.raises(ValueError, match="can't be applied"):
        opcodes.applied(df, [O(9)], 4, 4)
    with pytest.raises(ValueError, match="not inside"):
        opcodes.applied(df, [O(7, rect=(0, 0, 5, 4), params=(1,))], 4, 4)
    with pytest.raises(ValueError, match="full scale"):
        opcodes.applied(df, [O(10, rect=(0, 0, 4, 4), params=(2.0,))], 4, 4)
    out = opcodes.applied(df, [O(9, flags=1), O(6, rect=(1, 1, 4, 4)), O(4, params=(100,)), O(10, rect=(0, 0, 3, 3), params=(0.5, 0.0, -0.5))], 4, 4).collect()
    assert {(r.y, r.v) for r in out} == {(0, 32867), (1, 100), (2, 0)} and all(r.bad for r in out) and len(out) == 9
    assert random


def test_sensors_by_many_equal_ranges(spark):
    """A camera's array has each range once, however many sensors it has; what is chosen is what a walk through all of them finds."""
    own = [("A", "x", k, k, 4000 + k, 0 if k == 5 else k % 4 * 100, 0 if k % 3 == 0 else k % 4 * 100 + 150) for k in range(1, 1001)] + [("B", "y", 1, 7, 8, 100, 200)]
    s = spark.createDataFrame(own, "make string, model string, ord long, black long, white long, iso_min long, iso_max long")
    shots = [(i, m, n, iso) for i, (m, n, iso) in enumerate((m, n, iso) for m, n in ((" A\t", "x"), ("A", "x"), ("B", "y"), ("C", "x"), (None, "x"), ("A", None)) for iso in (None, 0, 50, 120, 260, 9999))]
    sizes = {r.make: (len(r.sensors), r.n) for r in catalog.sensor_arrays(s).collect()}
    assert sizes["A"][0] <= 9 and sizes["A"][1] == 1000 and sizes["B"] == (1, 1)

    def walked(make, model, iso):
        mine = [x for x in own if x[:2] == ((make or "").strip(" \t"), model)]
        within = [x for x in mine if iso is not None and (x[5] <= iso <= x[6] or (iso >= x[5] and x[6] == 0))]
        plain = [x for x in within if x[5] or x[6]]
        return (mine if len(mine) == 1 else plain or within or [None])[0]

    got = {r.id: r.sensor and r.sensor.ord for r in catalog.choose_sensor(spark.createDataFrame(shots, "id long, make string, model string, iso long"), s).collect()}
    want = {i: (w := walked(*x)) and w[2] for i, *x in shots}
    assert got == want
