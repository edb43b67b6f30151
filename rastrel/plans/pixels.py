"""Queries on samples: levels, tables, gains."""

from pyspark.sql import functions as F

from ..functions import cfa
from ..operators import pixels as P
from ..registry import query
from . import fixtures as X

PLANE = f"WITH {X.plane_sql()}"
MUL = "CAST(trunc(CAST(1073725440.0::DOUBLE / ({w} - {b}) AS FLOAT)) AS BIGINT)"
BLACKS, WHITE = [64, 96, 128, 160], 52000
BLACK_SQL = "CASE 2 * (y & 1) + (x & 1) WHEN 0 THEN 64 WHEN 1 THEN 96 WHEN 2 THEN 128 ELSE 160 END"
ROI = "y >= 2 AND y < 18 AND x >= 4 AND x < 44 AND (y - 2) % 2 = 0 AND (x - 4) % 3 = 0"


def roi():
    return P.in_roi(2, 4, 18, 44, 2, 3)


def plane(spark, sf_dir):
    return X.plane_u16(spark, sf_dir)


@query(f"{PLANE} SELECT image_id, y, x, greatest(0, least(65535, ((v - b) * {MUL.format(w=WHITE, b='b')} + 8192) >> 14)) AS v FROM (SELECT *, CAST({BLACK_SQL} AS BIGINT) AS b FROM plane)")
def pix04_scale_u16(spark, sf_dir):
    return P.scale_by_cell(plane(spark, sf_dir), BLACKS, WHITE)


@query(f"WITH {X.PLANE_F32} SELECT image_id, y, x, round(CAST(CAST((CAST(v AS DOUBLE) + 0.25) * 65535 / 0.75 AS FLOAT) AS DOUBLE), 2) AS v FROM fplane")
def pix07_scale_f32(spark, sf_dir):
    v = P.scaled_f32(F.col("v").cast("double"), F.lit(-0.25), F.lit(0.5))
    return X.plane_f32(spark, sf_dir).withColumn("v", F.round(v.cast("double"), 2))


@query(f"{PLANE} SELECT image_id, min(v) AS black, max(v) AS white FROM plane WHERE y >= 3 AND y < 17 AND x >= 6 AND x < 50 GROUP BY image_id")
def pix08_estimate_levels(spark, sf_dir):
    return P.estimated_levels(plane(spark, sf_dir), X.WIDTH, X.HEIGHT, 3)


@query(f"{PLANE} SELECT * FROM plane")
def pix09_no_op_levels(spark, sf_dir):
    return P.scale_by_cell(plane(spark, sf_dir), [0, 0, 0, 0], 65535)


TABLE = [min(65535, i * i // 1000) for i in range(4096)]


@query(f"{PLANE} SELECT image_id, y, x, least(65535, least(v, 4095) * least(v, 4095) // 1000) AS v FROM plane")
def pix10_look_up(spark, sf_dir):
    return plane(spark, sf_dir).withColumn("v", P.looked_up(F.col("v"), TABLE))


CURVE = "curve AS (SELECT CAST(i AS BIGINT) AS i, CAST(i * i % 977 * 60 AS BIGINT) AS c FROM (SELECT range AS i FROM range(0, 1024)))"


@query(f"WITH {CURVE}, s AS (SELECT i, c, least(coalesce(lag(c) OVER (ORDER BY i), c), c) AS lo, greatest(coalesce(lead(c) OVER (ORDER BY i), c), c) AS hi FROM curve) SELECT i, greatest(0, least(65535, c - (hi - lo + 2) // 4)) AS base, hi - lo AS delta FROM s")
def pix13_dither_table(spark, sf_dir):
    return P.dither_table(spark.range(1024).selectExpr("id AS i", "id * id % 977 * 60 AS c"))


def _noise_sql(seed, factor):
    """r(image_id, y, x, r): the generator's state at each sample, step by step."""
    step = lambda r: f"({r} & 65535) * {factor} + ({r} >> 16)"
    return f"""w AS (SELECT DISTINCT image_id, y, CAST({seed} AS BIGINT) AS s FROM plane),
r AS (SELECT image_id, y, CAST(0 AS BIGINT) AS x, {step('s')} AS r FROM w UNION ALL SELECT image_id, y, x + 1, {step('r')} FROM r WHERE x < {X.WIDTH - 1})"""


RECURSIVE = f"WITH RECURSIVE {X.plane_sql()}"


@query(f"{RECURSIVE}, {_noise_sql(f'xor({X.WIDTH} + 13 * y, 1164526980)', 15700)} SELECT image_id, y, x, v // 2 + (((v % 512) * (r & 2047) + 1024) >> 12) AS v FROM plane JOIN r USING (image_id, y, x)")
def pix11_dithered_look_up(spark, sf_dir):
    v = F.col("v")
    return plane(spark, sf_dir).select("image_id", "y", "x", P.dithered(F.floor(v / 2), v % 512, F.col("x"), F.col("y"), X.WIDTH).alias("v"))


@query(f"{PLANE} SELECT image_id, y, x, v AS uncorrected, least(65535, least(v, 4095) * least(v, 4095) // 1000) AS corrected, round(v / 65535.0, 6) AS share FROM plane")
def pix12_set_with_look_up(spark, sf_dir):
    v = F.col("v")
    return plane(spark, sf_dir).select("image_id", "y", "x", v.alias("uncorrected"), P.looked_up(v, TABLE).alias("corrected"), F.round(v / F.lit(65535.0), 6).alias("share"))


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN {ROI} THEN least(65535, least(v, 4095) * least(v, 4095) // 1000) ELSE v END AS v FROM plane")
def pix15_table_map(spark, sf_dir):
    return P.mapped(plane(spark, sf_dir), roi(), P.looked_up(F.col("v"), TABLE))


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN {ROI} THEN greatest(0, least(65535, CAST(trunc((((0.25 * u + 0.5) * u + 0.125) * u + 0.0625) * 65535.5::DOUBLE) AS BIGINT))) ELSE v END AS v FROM (SELECT *, v::DOUBLE / 65536 AS u FROM plane)")
def pix16_polynomial_map(spark, sf_dir):
    return P.mapped(plane(spark, sf_dir), roi(), P.polynomial(F.col("v"), [0.0625, 0.125, 0.5, 0.25]))


GAIN = "CAST(((y // 2) % 7 - 3) / 64.0::DOUBLE AS FLOAT)"


def gains(spark, base=0.0):
    return spark.range(64).selectExpr("id AS i", f"cast({base}D + (id % 7 - 3) / 64.0D AS float) AS f")


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN {ROI} THEN greatest(0, least(65535, CAST(trunc(65535::FLOAT * CAST((((y - 2) // 2) % 7 - 3) / 64.0::DOUBLE AS FLOAT)) AS BIGINT) + v)) ELSE v END AS v FROM plane")
def pix17_delta_per_row(spark, sf_dir):
    df = P.by_line(plane(spark, sf_dir), "y", gains(spark), first=2, pitch=2)
    return P.mapped(df, roi(), P.offset_u16(F.col("v"), F.col("f"))).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN {ROI} THEN greatest(0, least(65535, (CAST(trunc(1024::FLOAT * CAST(1 + (((x - 4) // 3) % 7 - 3) / 64.0::DOUBLE AS FLOAT)) AS BIGINT) * v + 512) >> 10)) ELSE v END AS v FROM plane")
def pix18_scale_per_column(spark, sf_dir):
    df = P.by_line(plane(spark, sf_dir), "x", gains(spark, 1.0), first=4, pitch=3)
    return P.mapped(df, roi(), P.gain_u16(F.col("v"), F.col("f"))).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y, x, v, (y // 2) % 7 AS line, round(CAST({GAIN} AS DOUBLE), 6) AS f FROM plane")
def jon06_row_vector(spark, sf_dir):
    return P.by_line(plane(spark, sf_dir), "y", gains(spark), pitch=2).selectExpr("image_id", "y", "x", "v", "y div 2 % 7 AS line", "round(cast(f AS double), 6) AS f")


@query(f"{PLANE} SELECT image_id, y, x, {ROI} AS hit FROM plane")
def flt12_roi_with_pitch(spark, sf_dir):
    return plane(spark, sf_dir).select("image_id", "y", "x", roi().alias("hit"))


@query(f"{PLANE} SELECT image_id, y - 2 AS y, x - 4 AS x, v FROM plane WHERE y >= 2 AND y < 18 AND x >= 4 AND x < 44")
def pix19_trim_bounds(spark, sf_dir):
    from ..operators.geometry import Rect, sub_frame

    return sub_frame(plane(spark, sf_dir), Rect(4, 2, 40, 16), X.WIDTH, X.HEIGHT).select("image_id", "y", "x", "v")


@query(f"""{PLANE} SELECT image_id, y - 2 AS y, x - 4 AS x, greatest(0, least(65535, (CAST(trunc(1024::FLOAT * CAST(1 + ((x - 4) % 7 - 3) / 64.0::DOUBLE AS FLOAT)) AS BIGINT) *
 greatest(0, least(65535, CAST(trunc((v::DOUBLE / 65536 * 0.5 + 0.25) * 65535.5::DOUBLE) AS BIGINT))) + 512) >> 10)) AS v FROM plane WHERE y >= 2 AND y < 18 AND x >= 4 AND x < 44""")
def pix20_opcode_list(spark, sf_dir):
    """An opcode list is a fold of transforms."""
    from ..operators.opcodes import Opcode, applied

    ops = [Opcode(6, rect=(2, 4, 18, 44)), Opcode(8, rect=(0, 0, 16, 40), params=(0.25, 0.5)), Opcode(13, rect=(0, 0, 16, 40), params=tuple(1 + (i % 7 - 3) / 64 for i in range(40))), Opcode(3, flags=1)]
    return applied(plane(spark, sf_dir), ops, X.WIDTH, X.HEIGHT).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN y < 8 THEN CASE WHEN x < 30 THEN v ELSE v // 2 END ELSE CASE WHEN x < 30 THEN least(65535, v + 7) ELSE v // 3 END END AS v FROM plane")
def jon09_quadrant_curves(spark, sf_dir):
    from ..operators.corrections import by_quadrant

    v = F.col("v")
    return by_quadrant(plane(spark, sf_dir), 8, 30, [[v, F.expr("v div 2")], [F.least(F.lit(65535), v + 7), F.expr("v div 3")]])


@query(f"{PLANE} SELECT image_id, y, x, CASE 3 * (y % 2) + x % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' WHEN 3 THEN 'GREEN' WHEN 4 THEN 'BLUE' ELSE 'RED' END AS color FROM plane")
def jon07_filter_color(spark, sf_dir):
    return plane(spark, sf_dir).select("image_id", "y", "x", cfa.color_at(["RED", "GREEN", "BLUE", "GREEN", "BLUE", "RED"], 3, 2, F.col("x"), F.col("y")).alias("color"))


GRID = [[1.0, 1.25, 1.5], [0.75, 1.0, 1.25], [0.5, 0.75, 1.0]]


@query(f"""{PLANE}, g AS (SELECT *, least(x // 20, 1) AS cx, least(y // 8, 1) AS cy FROM plane), f AS (SELECT *, (x - cx * 20) / 20.0::DOUBLE AS fx, (y - cy * 8) / 8.0::DOUBLE AS fy FROM g),
k AS (SELECT *, [1.0, 1.25, 1.5, 0.75, 1.0, 1.25, 0.5, 0.75, 1.0]::DOUBLE[] AS t, cy * 3 + cx + 1 AS i FROM f)
SELECT image_id, y, x, greatest(0, least(65535, CAST(trunc(v * ((t[i] * (1 - fx) + t[i + 1] * fx) * (1 - fy) + (t[i + 3] * (1 - fx) + t[i + 4] * fx) * fy)) AS BIGINT))) AS v FROM k""")
def pix22_flat_field(spark, sf_dir):
    return plane(spark, sf_dir).withColumn("v", P.clamped((F.col("v") * P.bilinear(F.col("x"), F.col("y"), GRID, 20, 8)).cast("long")))


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN m < 512 THEN m + 2 ELSE m END AS v FROM (SELECT *, ((v % 1024) << 2) | ((x + y) % 4) AS m FROM plane)")
def pix24_low_bits(spark, sf_dir):
    return plane(spark, sf_dir).withColumn("v", P.low_bits_merged(F.expr("v % 1024"), F.expr("(x + y) % 4"), narrow=True))


@query(f"{PLANE} SELECT image_id, CASE WHEN (x + y) % 2 = 1 THEN CASE WHEN x % 2 = 1 THEN y + 1 ELSE y - 1 END ELSE y END AS y, CASE WHEN (x + y) % 2 = 1 THEN CASE WHEN x % 2 = 1 THEN x - 1 ELSE x + 1 END ELSE x END AS x, v FROM plane")
def pix25_red_blue_swap(spark, sf_dir):
    return P.red_blue_swapped(plane(spark, sf_dir)).select("image_id", "y", "x", "v")


YCC = "t AS (SELECT *, v % 4096 AS yy, (v * 7) % 4096 AS cb, (v * 13) % 4096 AS cr FROM plane)"


def ycc(spark, sf_dir):
    return plane(spark, sf_dir).selectExpr("image_id", "y", "x", "v % 4096 AS yy", "v * 7 % 4096 AS cb", "v * 13 % 4096 AS cr")


@query(f"{PLANE}, {YCC} SELECT image_id, y, x, " + ", ".join(f"greatest(0, least(4095, CAST(trunc({e}) AS BIGINT))) AS {n}" for n, e in (("r", "yy + (cr - 2048) * 1.370705::DOUBLE"), ("g", "yy + (cb - 2048) * -0.337633::DOUBLE + (cr - 2048) * -0.698001::DOUBLE"), ("b", "yy + (cb - 2048) * 1.732446::DOUBLE"))) + " FROM t")
def pix26_small_nef_rgb(spark, sf_dir):
    return ycc(spark, sf_dir).select("image_id", "y", "x", *[c.alias(n) for n, c in zip("rgb", P.snef_rgb(F.col("yy"), F.col("cb"), F.col("cr")), strict=True)])


@query(f"{PLANE} SELECT image_id, y, x, v - 16384 AS chroma, ((v - 16384) + coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - 16384, v - 16384)) >> 1 AS chroma_next FROM plane WHERE x % 2 = 0")
def pix27_chroma_between(spark, sf_dir):
    t = plane(spark, sf_dir).filter("x % 2 = 0").selectExpr("image_id", "y", "x", "v - 16384 AS chroma")
    return P.halfway_chroma(t, ["image_id", "y"], "x", "chroma")


def _yuv_sql(version):
    off, rows = P.YUV[version]
    return ", ".join(f"greatest(0, least(65535, ((yy + ((cb * ({b}) + cr * ({r})) >> 12) + ({off})) * {g}) >> 8)) AS {n}{version}" for n, g, (b, r) in zip("rgb", (300, 256, 400), rows, strict=True))


@query(f"{PLANE}, t AS (SELECT *, v % 16384 AS yy, (v * 7) % 4096 - 2048 AS cb, (v * 13) % 4096 - 2048 AS cr FROM plane) SELECT image_id, y, x, {', '.join(map(_yuv_sql, range(3)))} FROM t")
def pix28_yuv_to_rgb(spark, sf_dir):
    t = plane(spark, sf_dir).selectExpr("image_id", "y", "x", "v % 16384 AS yy", "v * 7 % 4096 - 2048 AS cb", "v * 13 % 4096 - 2048 AS cr")
    return t.select("image_id", "y", "x", *[c.alias(f"{n}{k}") for k in range(3) for n, c in zip("rgb", P.yuv_to_rgb(k, F.col("yy"), F.col("cb"), F.col("cr"), (300, 256, 400)), strict=True)])


@query(f"{PLANE} SELECT image_id, y, x, v FROM plane")
def pix30_copy(spark, sf_dir):
    return plane(spark, sf_dir).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y, x, v BETWEEN 0 AND 16383 AS fits14, v BETWEEN 0 AND 4095 AS fits12 FROM plane")
def flt15_value_range(spark, sf_dir):
    from ..functions import bits

    return plane(spark, sf_dir).select("image_id", "y", "x", bits.is_int_n(F.col("v"), 14).alias("fits14"), bits.is_int_n(F.col("v"), 12).alias("fits12"))


@query(f"{PLANE} SELECT image_id, y, x, round(pow(x / 50.0::DOUBLE, 1 / 2.4::DOUBLE), 9) AS g, least(65535, v * 2) AS t FROM plane")
def pix29_gamma(spark, sf_dir):
    from ..functions import curves

    return plane(spark, sf_dir).select("image_id", "y", "x", F.round(curves.power(F.col("x") / F.lit(50.0), 2.4), 9).alias("g"), F.least(F.lit(65535).cast("long"), F.col("v") * 2).alias("t"))


def _dither_sql():
    span = 65535.0 / (WHITE - BLACKS[0])
    import numpy as np

    full, half = int(np.float32(span) * np.float32(4)), int(np.float32(span) * np.float32(4095))
    return f"""{RECURSIVE}, {_noise_sql(f'{X.WIDTH} + y * 36969', 18000)}, u AS (SELECT *, CAST({BLACK_SQL} AS BIGINT) AS b FROM plane JOIN r USING (image_id, y, x))
SELECT image_id, y, x, greatest(0, least(65535, ((v - b) * {MUL.format(w=WHITE, b='b')} + 8192 + {half} - {full} * (r & 2047)) >> 14)) AS v FROM u"""


@query(_dither_sql())
def pix05_dithered_scale(spark, sf_dir):
    return P.scale_dithered(plane(spark, sf_dir), X.WIDTH, BLACKS, WHITE).select("image_id", "y", "x", "v")


KNOTS, GAINS = [8000, 16000, 24000, 32000, 40000, 48000, 56000], [[[10000 + 30 * i * k for i in range(7)] for k in (1, 2)], [[10000 - 20 * i * k for i in range(7)] for k in (1, 3)]]


def _quadrant_sql():
    from ..functions import curves

    def one(g):
        points = [(0, 0), *[(x, x * n // 10000) for x, n in zip(KNOTS, g, strict=True)], (65535, 65535)]
        parts = [f"WHEN u >= {x} THEN {a!r}::DOUBLE + (u - {x}) * ({b!r}::DOUBLE + (u - {x}) * ({c!r}::DOUBLE + (u - {x}) * {d!r}::DOUBLE))" for (x, _), (a, b, c, d) in reversed(list(zip(points, curves.spline(points), strict=False)))]
        return f"least(65535, CAST(trunc(greatest(0, least(65535, CASE {' '.join(parts)} END))) AS BIGINT) + 64)"

    (a, b), (c, d) = GAINS
    return f"{PLANE}, t AS (SELECT *, greatest(v - 64, 0) AS u FROM plane) SELECT image_id, y, x, CASE WHEN y < 8 THEN CASE WHEN x < 30 THEN {one(a)} ELSE {one(b)} END ELSE CASE WHEN x < 30 THEN {one(c)} ELSE {one(d)} END END AS v FROM t"


@query(_quadrant_sql())
def pix21_quadrant_multipliers(spark, sf_dir):
    from ..operators.corrections import quadrant_curves

    return quadrant_curves(plane(spark, sf_dir), 8, 30, 64, KNOTS, GAINS)


@query(f"{PLANE} SELECT image_id, y, x, least(65535, least(v, 4095) * least(v, 4095) // 1000) AS guarded, v AS uncorrected FROM plane")
def pix14_curve_guard(spark, sf_dir):
    """A curve is applied while decoding, or kept for later where raw values are wanted."""
    from ..operators.tiles import Options

    v = F.col("v")
    return plane(spark, sf_dir).select("image_id", "y", "x", Options().curved(v, TABLE).alias("guarded"), Options(uncorrected=True).curved(v, TABLE).alias("uncorrected"))


@query(f"{PLANE} SELECT image_id, y, x, v, least(65535, least(v, 4095) * least(v, 4095) // 1000) AS t FROM plane")
def jon05_table_join(spark, sf_dir):
    """A table as a relation: an equi-join on the value."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TABLE)], "i long, t long")
    p = plane(spark, sf_dir).withColumn("i", F.least(F.col("v"), F.lit(len(TABLE) - 1)))
    return p.join(table, "i").select("image_id", "y", "x", "v", "t")
