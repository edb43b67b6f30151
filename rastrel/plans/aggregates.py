"""Queries that sum up images and runs."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query
from . import fixtures as X

PLANE = f"WITH {X.plane_sql()}"
AREAS = [(0, 4, False), (0, 6, True)]


@query(f"{PLANE} SELECT image_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum((v & 255) + (v >> 8)) AS BIGINT) AS byte_total, CAST(sum(v) AS DOUBLE) / 1000 AS mean, CAST(sum((v & 255) + (v >> 8)) AS DOUBLE) / 2000 AS byte_mean FROM plane GROUP BY image_id")
def agg01_sum_and_mean(spark, sf_dir):
    return A.sum_and_mean(X.plane_u16(spark, sf_dir), X.WIDTH, X.HEIGHT)


@query(f"""{PLANE}, r AS (SELECT image_id, y, md5(unhex(string_agg(lpad(lower(to_hex(((v & 255) << 8) | (v >> 8))), 4, '0'), '' ORDER BY x))) AS d FROM plane GROUP BY ALL)
SELECT image_id, md5(unhex(string_agg(d, '' ORDER BY y))) AS digest FROM r GROUP BY image_id""")
def agg02_digest_of_digests(spark, sf_dir):
    return A.digest(X.plane_u16(spark, sf_dir))


MASKED = f"""{PLANE}, m AS (
  SELECT image_id, 2 * (y & 1) + o AS cell, v, 22 AS n FROM plane, (SELECT unnest([0, 1]) AS o) WHERE x = 6 AND y < 4
  UNION ALL SELECT image_id, 2 * (y & 1) + o AS cell, v, 3 AS n FROM plane, (SELECT unnest([0, 1]) AS o) WHERE x = 0 AND y >= 4 AND y < 20),
h AS (SELECT image_id, cell, v, sum(n) % 65536 AS n FROM m GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id, cell ORDER BY v) AS upto FROM h)"""


@query(f"{MASKED} SELECT image_id, CAST(cell AS INTEGER) AS cell, coalesce(min(v) FILTER (upto > {(4 * 44 + 6 * 16) // 8}), 65535) AS black FROM c GROUP BY ALL")
def agg03_black_median(spark, sf_dir):
    return A.black_median(X.plane_u16(spark, sf_dir), AREAS, 6, 4, 44, 16)


@query(f"WITH {X.PLANE_F32} SELECT image_id, CAST(2 * (y & 1) + (x & 1) AS INTEGER) AS cell, round(sum(v::DOUBLE * ((y < 4 AND x >= 6)::INT + (x < 6 AND y >= 4)::INT)) * 65535 / 101.0::DOUBLE, 3) AS black FROM fplane WHERE (y < 4 AND x >= 6) OR (x < 6 AND y >= 4) GROUP BY ALL")
def agg04_black_mean(spark, sf_dir):
    """(4 * 59 + 6 * 28) / 4 samples a cell: the crop is 59 by 28, and one column is not part of it."""
    p = X.plane_f32(spark, sf_dir).filter("x < 65")
    return A.black_mean(p, AREAS, 6, 4, 59, 28).withColumn("black", F.round("black", 3))


@query(f"{PLANE} SELECT image_id, min(v) AS low, max(v) AS high FROM plane GROUP BY image_id")
def agg05_extremes(spark, sf_dir):
    return X.plane_u16(spark, sf_dir).groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


@query(f"{PLANE}, t AS (SELECT image_id, y % 2 AS parity, v FROM plane WHERE x = 0) SELECT image_id, parity, round(sum(v) / 20.0::DOUBLE * 2, 6) AS delta FROM t GROUP BY ALL")
def agg06_black_deltas(spark, sf_dir):
    t = X.plane_u16(spark, sf_dir).filter("x = 0")
    return A.black_deltas(t, "image_id", "y", "v").withColumn("delta", F.round("delta", 6))


@query(f"{PLANE} SELECT image_id, CAST(2 * (y & 1) + (x & 1) AS INTEGER) AS cell, v, count(*) AS n FROM plane GROUP BY ALL")
def agg07_histogram(spark, sf_dir):
    return A.histogram(X.plane_u16(spark, sf_dir))


@query("SELECT count(*) AS files, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS ms, count(*) FILTER (event_id % 13 = 5) AS failed, arg_min(event_type, event_id) FILTER (event_id % 13 = 5) AS first_error FROM events")
def agg08_time_and_failures(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").selectExpr("event_id AS ord", "cast(floor(value * 100) AS bigint) AS ms", "IF(event_id % 13 = 5, event_type, NULL) AS error")
    return A.runs(t)


@query("""SELECT event_type, round(sum(value), 4) AS cpu, round(sum(value) * 0.5, 4) AS wall, CAST(count(*) * 1000 AS BIGINT) AS samples, count(*) AS files, round(sum(value) / (sum(value) * 0.5), 4) AS busy,
 round(count(*) * 1000 / (sum(value) * 0.5), 4) AS samples_per_s, round(count(*) * 1000 / sum(value), 4) AS samples_per_cpu_s, round(count(*) / (sum(value) * 0.5), 6) AS files_per_s FROM events GROUP BY event_type""")
def agg09_throughput(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").selectExpr("event_type", "value AS cpu", "value * 0.5D AS wall", "1000L AS samples")
    out = A.throughput(t, "event_type")
    return out.select("event_type", *[F.round(c, 6 if c == "files_per_s" else 4).alias(c) if c not in ("samples", "files") else F.col(c) for c in out.columns[1:]])


@query("WITH c AS (SELECT user_id, list(event_id % 5 ORDER BY event_id) AS counts FROM events GROUP BY user_id) SELECT user_id, CAST(list_sum(counts) AS BIGINT) AS n_codes, CAST(list_max(list_transform(counts, lambda c, i: c + i)) AS BIGINT) AS longest FROM c")
def agg12_code_lengths(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id"))).alias("e"))
    counts = t.select("user_id", F.transform("e", lambda s: s["event_id"] % 5).alias("counts"))
    return counts.select("user_id", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n_codes"), F.array_max(F.transform("counts", lambda c, i: c + i + 1)).alias("longest"))


@query(f"{PLANE}, a AS (SELECT * FROM (VALUES (0, 4, false), (10, 6, true)) t(o, s, vertical)) SELECT image_id, o, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM plane, a WHERE CASE WHEN vertical THEN x >= o AND x < o + s AND y >= 4 ELSE y >= o AND y < o + s AND x >= 6 END GROUP BY ALL")
def jon08_samples_in_areas(spark, sf_dir):
    areas = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(v).alias("vertical")) for o, s, v in ((0, 4, False), (10, 6, True))])  # an image has a few
    x, y = F.col("x"), F.col("y")
    hit = lambda a: F.when(a["vertical"], (x >= a["o"]) & (x < a["o"] + a["s"]) & (y >= 4)).otherwise((y >= a["o"]) & (y < a["o"] + a["s"]) & (x >= 6))
    met = X.plane_u16(spark, sf_dir).select("image_id", "v", F.explode_outer(F.filter(areas, hit)).alias("a")).filter("a IS NOT NULL")
    return met.groupBy("image_id", F.col("a.o").alias("o")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
