"""Queries with neighbourhoods."""

from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..registry import query
from . import fixtures as X


def marked(spark, sf_dir, width=X.WIDTH):
    return X.plane_u16(spark, sf_dir, width).withColumn("bad", F.expr("v % 97 = 0"))


def _nearest_sql(src, ok, width, step=2):
    return f"""WITH {src}, n AS (SELECT *,
  last_value(CASE WHEN {ok} THEN v END IGNORE NULLS) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vl, coalesce(x - last_value(CASE WHEN {ok} THEN x END IGNORE NULLS) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dl,
  first_value(CASE WHEN {ok} THEN v END IGNORE NULLS) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS vr, coalesce(first_value(CASE WHEN {ok} THEN x END IGNORE NULLS) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - x, 0) AS dr,
  last_value(CASE WHEN {ok} THEN v END IGNORE NULLS) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vu, coalesce(y - last_value(CASE WHEN {ok} THEN y END IGNORE NULLS) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS du,
  first_value(CASE WHEN {ok} THEN v END IGNORE NULLS) OVER (u ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS vd, coalesce(first_value(CASE WHEN {ok} THEN y END IGNORE NULLS) OVER (u ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - y, 0) AS dd
  FROM plane WINDOW h AS (PARTITION BY image_id, y, x % {step} ORDER BY x), u AS (PARTITION BY image_id, x, y % {step} ORDER BY y))"""


def _fix_sql(width):
    return _nearest_sql(X.plane_sql(width), "v % 97 <> 0", width) + f""",
w AS (SELECT *, CASE WHEN dl > 0 THEN (dr * 256) // (dl + dr) ELSE 0 END AS wl, CASE WHEN du > 0 THEN (dd * 256) // (du + dd) ELSE 0 END AS wu FROM n),
f AS (SELECT *, (CASE WHEN dl + dr > 0 THEN coalesce(vl, 0) * wl + coalesce(vr, 0) * (256 - wl) ELSE 0 END + CASE WHEN du + dd > 0 THEN coalesce(vu, 0) * wu + coalesce(vd, 0) * (256 - wu) ELSE 0 END)
  >> CAST(7 + (dl + dr > 0)::INT + (du + dd > 0)::INT AS BIGINT) AS fixed FROM w)
SELECT image_id, y, x, CASE WHEN v % 97 = 0 AND x < {32 * ((width + 15) // 32)} THEN greatest(0, least(65535, fixed)) ELSE v END AS v FROM f"""


@query(_fix_sql(50))
def win01_fix_bad_u16(spark, sf_dir):
    return N.repaired_u16(marked(spark, sf_dir), 50).select("image_id", "y", "x", "v")


@query(_fix_sql(40))
def win03_bad_sweep_leaves_tail(spark, sf_dir):
    return N.repaired_u16(marked(spark, sf_dir, 40), 40).select("image_id", "y", "x", "v")


@query(_nearest_sql(X.plane_sql(), "v % 97 <> 0", 50) + " SELECT image_id, y, x, vl, dl, vr, dr, vu, du, vd, dd FROM n WHERE v % 97 = 0")
def jon13_nearest_valid(spark, sf_dir):
    n = N.nearest(marked(spark, sf_dir).withColumn("ok", ~F.col("bad"))).filter("bad")
    return n.select("image_id", "y", "x", *[F.col(f"n{a}_{b}").alias(f"{a}{b}") for b in "lrud" for a in "vd"])


@query(f"WITH {X.plane_sql()} SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM plane p WHERE NOT EXISTS (SELECT 1 FROM plane b WHERE b.v % 97 = 0 AND b.image_id = p.image_id AND b.x = p.x AND b.y = p.y) GROUP BY image_id")
def jon10_valid_samples(spark, sf_dir):
    p = X.plane_u16(spark, sf_dir)
    return p.join(p.filter("v % 97 = 0").select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti").groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {X.plane_sql()} SELECT image_id, x, y, x | (y << 16) AS packed FROM plane WHERE v % 97 = 0")
def agg11_bad_pixel_list(spark, sf_dir):
    return X.plane_u16(spark, sf_dir).filter("v % 97 = 0").select("image_id", "x", "y", F.col("x").bitwiseOR(F.shiftleft("y", 16)).alias("packed"))


@query(f"""WITH {X.plane_sql()}, n AS (SELECT a.*, {', '.join(f'{c}.v AS {c}' for c in 'bcdefghijk')} FROM plane a
{' '.join(f'LEFT JOIN plane {c} ON {c}.image_id = a.image_id AND {c}.x = a.x + ({dx}) AND {c}.y = a.y + ({dy})' for c, dx, dy in (('b', -1, -1), ('c', -1, 1), ('d', 1, -1), ('e', 1, 1), ('f', -2, 2), ('g', -2, -2), ('h', 2, 2), ('i', 2, -2), ('j', -2, 0), ('k', 2, 0)))}),
s AS (SELECT *, b + c + d + e AS t, [b, c, d, e] AS q, [abs(b * 4 - b - c - d - e), abs(c * 4 - b - c - d - e), abs(d * 4 - b - c - d - e), abs(e * 4 - b - c - d - e)] AS far FROM n)
SELECT image_id, y, x, CASE WHEN x IN (7, 20) AND y >= 2 AND y < 18 THEN CASE WHEN (x + y) % 2 = 1 THEN (t - q[list_position(far, list_max(far))] + 1) // 3
  ELSE CAST(round((f + g + h + i) * 0.0732233::DOUBLE + (j + k) * 0.3535534::DOUBLE) AS BIGINT) END ELSE v END AS v FROM s""")
def win04_bad_columns(spark, sf_dir):
    return N.repaired_columns(X.plane_u16(spark, sf_dir), [7, 20], F.expr("(x + y) % 2 = 1"), X.HEIGHT)


DIFFS = "d AS (SELECT image_id, y, x, v % 512 - 256 AS v FROM plane)"


@query(f"""WITH {X.plane_sql()}, {DIFFS}, s AS (SELECT image_id, y, sum(v) OVER (PARTITION BY image_id ORDER BY y) AS seed FROM d WHERE x = 0)
SELECT d.image_id, d.y, d.x, CAST(sum(CASE WHEN d.x > 0 THEN d.v ELSE 0 END) OVER (PARTITION BY d.image_id, d.y ORDER BY d.x) + seed AS BIGINT) & 65535 AS v FROM d JOIN s ON d.image_id = s.image_id AND d.y = s.y""")
def win11_running_predictor(spark, sf_dir):
    return N.running_predictor(X.plane_u16(spark, sf_dir).withColumn("v", F.expr("v % 512 - 256")))


@query(f"""WITH {X.plane_sql()}, {DIFFS}, s AS (SELECT image_id, y, x AS lane, sum(v) OVER (PARTITION BY image_id, x, y % 2 ORDER BY y) AS seed FROM d WHERE x < 2)
SELECT d.image_id, d.y, d.x, CAST(sum(CASE WHEN d.x > 1 THEN d.v ELSE 0 END) OVER (PARTITION BY d.image_id, d.y, d.x % 2 ORDER BY d.x) + seed AS BIGINT) & 65535 AS v
FROM d JOIN s ON d.image_id = s.image_id AND d.y = s.y AND d.x % 2 = s.lane""")
def win11_two_lane_predictor(spark, sf_dir):
    return N.running_predictor(X.plane_u16(spark, sf_dir).withColumn("v", F.expr("v % 512 - 256")), parity=2)


def _taps(odd, n):
    at = {k: f"lead(low, {k}) OVER w" if k > 0 else f"lag(low, {-k}) OVER w" if k else "low" for k in range(-2, 3)}
    e = {name: f"(((high * ({t[odd][0]}) + ((({' + '.join(f'({at[t[2] + i]}) * ({m})' for i, m in enumerate(t[odd][1:]))}) + 4) >> 3)) << 1) >> 1)" for name, t in N.TAPS.items()}
    e = {k: f"((high * ({N.TAPS[k][odd][0]}) + ((({' + '.join(f'({at[N.TAPS[k][2] + i]}) * ({m})' for i, m in enumerate(N.TAPS[k][odd][1:]))}) + 4) >> 3)) >> 1)" for k in e}
    return f"CASE WHEN y = 0 THEN {e['first']} WHEN y < {n - 1} THEN {e['middle']} ELSE {e['last']} END"


@query(f"""WITH {X.plane_sql()}, b AS (SELECT image_id, x, y, v // 4 AS low, v % 256 - 128 AS high FROM plane), e AS (SELECT image_id, x, y, {_taps(0, 20)} AS even, {_taps(1, 20)} AS odd FROM b WINDOW w AS (PARTITION BY image_id, x ORDER BY y))
SELECT image_id, x, y * 2 AS y, even AS v FROM e UNION ALL SELECT image_id, x, y * 2 + 1, odd FROM e""")
def win13_wavelet_synthesis(spark, sf_dir):
    b = X.plane_u16(spark, sf_dir).selectExpr("image_id", "x", "y", "v div 4 AS low", "v % 256 - 128 AS high")
    return N.synthesized(b, "x", "y", X.HEIGHT)


@query(f"WITH {X.plane_sql()} SELECT image_id, y, x, lead(v, 2) OVER (PARTITION BY image_id, y ORDER BY x) AS ahead, lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS above FROM plane")
def win14_stencil(spark, sf_dir):
    return N.shifted(X.plane_u16(spark, sf_dir), {"ahead": (2, 0), "above": (0, -1)}).select("image_id", "y", "x", "ahead", "above")


@query("SELECT CAST(i AS BIGINT) AS i, ((64 - i % 64) * k1 + i % 64 * k2) // 64 AS v FROM (SELECT range AS i, (range // 64) * (range // 64) * 50 AS k1, (range // 64 + 1) * (range // 64 + 1) * 50 AS k2 FROM range(0, 1024))")
def win15_knot_interpolation(spark, sf_dir):
    from ..functions import curves

    t = curves.interpolated_table([k * k * 50 for k in range(17)], 1024).tolist()
    from ..operators.pixels import table_column

    return spark.range(1024).select(F.col("id").alias("i"), F.get(table_column(t), F.col("id").cast("int")).alias("v"))


def _fix_f32_sql():
    base = _nearest_sql(X.PLANE_F32 + ", plane AS (SELECT *, (x * 7 + y * 3) % 23 = 0 AS bad FROM fplane)", "NOT bad AND v >= 0", 64, 1)
    far = """, g AS (SELECT *,
 coalesce(x - first_value(CASE WHEN NOT bad THEN x END IGNORE NULLS) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fl, coalesce(last_value(CASE WHEN NOT bad THEN x END IGNORE NULLS) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - x, 0) AS fr,
 coalesce(y - first_value(CASE WHEN NOT bad THEN y END IGNORE NULLS) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fu, coalesce(last_value(CASE WHEN NOT bad THEN y END IGNORE NULLS) OVER (u ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - y, 0) AS fd
 FROM n WINDOW h AS (PARTITION BY image_id, y ORDER BY x), u AS (PARTITION BY image_id, x ORDER BY y)),
k AS (SELECT *, CASE WHEN vl IS NULL THEN fl ELSE dl END AS el, CASE WHEN vr IS NULL THEN fr ELSE dr END AS er, CASE WHEN vu IS NULL THEN fu ELSE du END AS eu, CASE WHEN vd IS NULL THEN fd ELSE dd END AS ed FROM g),
w AS (SELECT *, CASE WHEN el > 0 THEN er / (el + er)::DOUBLE ELSE 0 END AS wl, CASE WHEN eu > 0 THEN ed / (eu + ed)::DOUBLE ELSE 0 END AS wu FROM k),
f AS (SELECT *, (CASE WHEN el + er > 0 THEN coalesce(vl::DOUBLE * wl, 0) + coalesce(vr::DOUBLE * (1 - wl), 0) ELSE 0 END + CASE WHEN eu + ed > 0 THEN coalesce(vu::DOUBLE * wu, 0) + coalesce(vd::DOUBLE * (1 - wu), 0) ELSE 0 END)
 / ((el + er > 0)::INT + (eu + ed > 0)::INT + 1e-6::DOUBLE) AS fixed FROM w)
SELECT image_id, y, x, round(CASE WHEN bad AND x < 64 THEN fixed ELSE v::DOUBLE END, 6) AS v FROM f"""
    return base + far


@query(_fix_f32_sql())
def win02_fix_bad_f32(spark, sf_dir):
    p = X.plane_f32(spark, sf_dir).withColumn("bad", F.expr("(x * 7 + y * 3) % 23 = 0"))
    return N.repaired_f32(p, 64, step=1).select("image_id", "y", "x", F.round("v", 6).alias("v"))
