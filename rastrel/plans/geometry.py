"""Queries on areas, tiles, slices and ranges."""

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..registry import query
from . import fixtures as X

PLANE = f"WITH {X.plane_sql()}"


@query(f"{PLANE} SELECT image_id, y - 3 AS y, x - 5 AS x, v FROM plane WHERE x >= 5 AND x < 45 AND y >= 3 AND y < 18")
def pix01_crop(spark, sf_dir):
    return G.sub_frame(X.plane_u16(spark, sf_dir), G.Rect(5, 3, 40, 15), X.WIDTH, X.HEIGHT).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y - 2 AS y, x - 4 AS x, v FROM plane WHERE x >= 4 AND x < 44 AND y >= 2 AND y < 20")
def pix02_relative_crop(spark, sf_dir):
    r = G.relative_crop(4, 2, -6, 0, X.WIDTH, X.HEIGHT)
    return G.sub_frame(X.plane_u16(spark, sf_dir), r, X.WIDTH, X.HEIGHT).select("image_id", "y", "x", "v")


@query(f"{PLANE} SELECT image_id, y, x, CASE WHEN y >= 4 AND y < 12 AND x >= 10 AND x < 30 THEN 0 ELSE v END AS v FROM plane")
def pix03_clear_area(spark, sf_dir):
    return G.cleared(X.plane_u16(spark, sf_dir), G.Rect(10, 4, 30, 8), X.WIDTH, X.HEIGHT)


@query(f"{PLANE} SELECT image_id, y, x, x >= 5 AND y >= 3 AND x < 45 AND y < 15 AS inside, x >= 5 AND y >= 3 AND x <= 45 AND y <= 15 AS inclusive FROM plane")
def flt11_inside(spark, sf_dir):
    r = G.Rect(5, 3, 40, 12)
    return X.plane_u16(spark, sf_dir).select("image_id", "y", "x", G.contains(r).alias("inside"), G.contains(r, inclusive=True).alias("inclusive"))


@query(f"WITH {X.RANGES} SELECT ord, s <= 1704100000 AND 1704100000 < e AS holds, s = 1704100000 OR (s < 1704100000 AND 1704100000 < e) OR (1704100000 < s AND s < 1704200000) AS meets FROM ranges")
def flt10_range_predicates(spark, sf_dir):
    s, e, at = F.col("s"), F.col("e"), F.lit(1704100000)
    return X.ranges(spark, sf_dir).select("ord", G.range_contains(s, e, at).alias("holds"), G.ranges_overlap(s, e, at, F.lit(1704200000)).alias("meets"))


CLASH = f"""WITH {X.RANGES}, t AS (SELECT *, coalesce(max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s OR lag(s) OVER w = s, false) AS clash
  FROM ranges WINDOW w AS (PARTITION BY grp ORDER BY s, e, ord))"""


@query(f"{CLASH} SELECT grp, ord, s, e, clash FROM t")
def jon11_overlap_detection(spark, sf_dir):
    return G.overlap_flags(X.ranges(spark, sf_dir), "grp", "s", "e", "ord").select("grp", "ord", "s", "e", "clash")


@query(f"{CLASH} SELECT grp, NOT bool_or(clash) AS accepted, count(*) AS n FROM t GROUP BY grp")
def set03_non_overlapping_set(spark, sf_dir):
    return G.overlap_flags(X.ranges(spark, sf_dir), "grp", "s", "e", "ord").groupBy("grp").agg((~F.bool_or("clash")).alias("accepted"), F.count("*").alias("n"))


@query(f"WITH {X.STRIPS} SELECT file_id, off, lead(off) OVER w - off AS size, coalesce(lag(off) OVER w = off, false) AS bad FROM strips WINDOW w AS (PARTITION BY file_id ORDER BY off)")
def win05_strip_sizes(spark, sf_dir):
    return G.strips_by_offset(X.strips(spark, sf_dir)).select("file_id", "off", "size", "bad")


@query(f"WITH {X.STRIPS} SELECT file_id, n, lead(off) OVER w - off AS size, coalesce(lead(off) OVER w <= off, false) AS bad FROM strips WINDOW w AS (PARTITION BY file_id ORDER BY n)")
def win06_strips_as_stored(spark, sf_dir):
    return G.strips_as_stored(X.strips(spark, sf_dir)).select("file_id", "n", "size", "bad")


@query(f"WITH {X.STRIPS} SELECT file_id, n, row_number() OVER (PARTITION BY file_id ORDER BY m) - 1 = m AS in_place FROM (SELECT file_id, n, n + CASE WHEN file_id % 3 = 0 AND n > 4 THEN 1 ELSE 0 END AS m FROM strips)")
def win07_dense_strips(spark, sf_dir):
    t = X.strips(spark, sf_dir).selectExpr("file_id", "n", "n + IF(file_id % 3 = 0 AND n > 4, 1, 0) AS m")
    return G.dense(t, "file_id", "m").select("file_id", "n", "in_place")


@query(f"""WITH {X.STRIPS}, t AS (SELECT *, off - lag(off + len) OVER (PARTITION BY file_id ORDER BY off, len) AS gap FROM strips)
SELECT file_id, min(off) AS begin, max(off + len) - min(off) AS span, CAST(sum(greatest(gap, 0)) AS BIGINT) AS padding, coalesce(bool_or(gap < 0), false) AS overlap FROM t GROUP BY file_id""")
def win08_slice_coalescing(spark, sf_dir):
    t = G.coalesced(X.strips(spark, sf_dir))
    return t.withColumn("padding", F.when(F.col("padding").isNotNull(), F.col("padding")).cast("long"))


@query("SELECT CAST(n AS BIGINT) AS n, n % 7 AS col, n // 7 AS row, n % 7 * 16 AS x, n // 7 * 12 AS y, least(16, 100 - n % 7 * 16) AS w, least(12, 80 - n // 7 * 12) AS h FROM (SELECT range AS n FROM range(0, 49))")
def win09_tile_geometry(spark, sf_dir):
    t = spark.range(0, 49).withColumnRenamed("id", "n")
    return t.withColumns({k: c.cast("long") for k, c in G.tiles(100, 80, 16, 12, F.col("n")).items()})


@query("""WITH t AS (SELECT event_id % 1000 AS k, event_id // 1000 AS image_id FROM events), s AS (SELECT *, CASE WHEN k < 400 THEN 0 WHEN k < 800 THEN 20 ELSE 40 END AS l, CASE WHEN k < 800 THEN 20 ELSE 10 END AS w FROM t)
SELECT image_id, k, CAST(l + (k - l * 20) % w AS BIGINT) AS x, CAST((k - l * 20) // w AS BIGINT) AS y FROM s""")
def win10_vertical_slices(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").selectExpr("event_id div 1000 AS image_id", "event_id % 1000 AS k")
    return t.withColumns({n: c.cast("long") for n, c in G.slices(F.col("k"), [20, 20, 10], 20).items()})


@query(f"{PLANE} SELECT image_id, (y + 1) // 2 + x AS x, 49 - x + y // 2 AS y, v FROM plane")
def pix23_diagonal_rotation(spark, sf_dir):
    return G.rotated45(X.plane_u16(spark, sf_dir), X.WIDTH).selectExpr("image_id", "x", "y", "v")


@query(f"WITH {X.STRIPS} SELECT file_id, coalesce(min(d) > 0, true) AS rising FROM (SELECT file_id, len - lag(len) OVER (PARTITION BY file_id ORDER BY n) AS d FROM strips) GROUP BY file_id")
def srt07_strictly_increasing(spark, sf_dir):
    return G.strictly_increasing(X.strips(spark, sf_dir), "file_id", "n", "len")


@query(f"WITH {X.STRIPS} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY off, n) AS place, n FROM strips")
def srt01_sorted_offsets(spark, sf_dir):
    return X.strips(spark, sf_dir).selectExpr("file_id", "cast(row_number() OVER (PARTITION BY file_id ORDER BY off, n) AS bigint) AS place", "n")


@query("""WITH r AS (SELECT event_id AS id, event_id % 40 AS x, event_id % 30 AS y, 1 + event_id % 3 AS w, 1 + event_id % 2 AS h FROM events)
SELECT id, px, py FROM r, LATERAL (SELECT unnest(range(x, x + w)) AS px), LATERAL (SELECT unnest(range(y, y + h)) AS py)""")
def set04_rectangles_to_points(spark, sf_dir):
    r = X.table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id % 40 AS x", "event_id % 30 AS y", "1 + event_id % 3 AS w", "1 + event_id % 2 AS h")
    return G.points(r).select("id", "px", "py")


@query("""SELECT event_id % 400 AS x, event_id % 30 AS y FROM events UNION SELECT user_id % 40 AS x, event_id % 300 AS y FROM events""")
def set01_bad_pixel_union(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return e.selectExpr("event_id % 400 AS x", "event_id % 30 AS y").unionByName(e.selectExpr("user_id % 40 AS x", "event_id % 300 AS y")).distinct()


@query("SELECT event_id AS file_id, i - 1 AS n, off, len, x, y FROM (SELECT event_id, unnest(range(1, 5)) AS i FROM events), LATERAL (SELECT event_id * 10 + i AS off, CAST(100 * i AS BIGINT) AS len, (i - 1) % 2 * 16 AS x, (i - 1) // 2 * 16 AS y)")
def jon12_tiles_with_byte_ranges(spark, sf_dir):
    """Offsets and counts of a file's tiles, zipped by position and placed."""
    t = X.table(spark, sf_dir, "events").selectExpr("event_id AS file_id", "transform(sequence(1, 4), i -> event_id * 10 + i) AS offs", "transform(sequence(1, 4), i -> 100L * i) AS lens")
    t = t.filter(F.size("offs") == F.size("lens")).select("file_id", F.posexplode(F.arrays_zip("offs", "lens")).alias("n", "t"))
    g = G.tiles(32, 32, 16, 16, F.col("n"))
    return t.select("file_id", F.col("n").cast("long").alias("n"), F.col("t.offs").alias("off"), F.col("t.lens").alias("len"), g["x"].cast("long").alias("x"), g["y"].cast("long").alias("y"))
