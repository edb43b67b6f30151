"""Catalog queries: joins of files and shots with cameras and sensor levels."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import geometry as G
from ..operators import pixels as P
from ..registry import query
from . import fixtures as X

DEDUP = "cams AS (SELECT make, model, mode, arg_min(doc_order, doc_order) AS doc_order, arg_min(size, doc_order) AS size, count(*) - 1 AS dropped FROM cameras GROUP BY ALL)"
TRIM = "trim({0}, ' ' || chr(9))"
CTE = f"WITH {X.CAMERAS}, {DEDUP}, {X.SHOTS}"
ON = f"{TRIM.format('s.make')} = c.make AND {TRIM.format('s.model')} = c.model"


def cams(spark, sf_dir):
    return C.first_wins(X.cameras(spark, sf_dir))


@query(f"WITH {X.CAMERAS}, {DEDUP} SELECT * FROM cams")
def set02_first_camera_wins(spark, sf_dir):
    return cams(spark, sf_dir)


@query(f"WITH {X.CAMERAS}, {DEDUP} SELECT row_number() OVER (ORDER BY make, model, mode) AS place, make, model, mode FROM cams")
def srt06_ordered_catalog(spark, sf_dir):
    return cams(spark, sf_dir).selectExpr("cast(row_number() OVER (ORDER BY make, model, mode) AS bigint) AS place", "make", "model", "mode")


@query(f"{CTE} SELECT s.iso, count(*) AS n, count(c.doc_order) AS found, CAST(sum(c.size) AS BIGINT) AS size_sum FROM shots s LEFT JOIN cams c ON {ON} AND s.mode = c.mode GROUP BY s.iso")
def jon01_camera_by_names(spark, sf_dir):
    return C.look_up(X.shots(spark, sf_dir), cams(spark, sf_dir)).groupBy("iso").agg(F.count("*").alias("n"), F.count("doc_order").alias("found"), F.sum("size").alias("size_sum"))


@query(f"WITH {X.CAMERAS}, {DEDUP} SELECT make, model, min(mode) AS mode, arg_min(doc_order, mode) AS doc_order FROM cams GROUP BY make, model")
def jon02_camera_by_any_mode(spark, sf_dir):
    return C.any_mode(cams(spark, sf_dir)).select("make", "model", "mode", "doc_order")


@query(f"""WITH {X.CAMERAS}, {DEDUP}, chdk AS (SELECT size, arg_max(make, doc_order) AS make, arg_max(model, doc_order) AS model, max(doc_order) AS doc_order FROM cams WHERE contains(mode, 'chdk') GROUP BY size)
SELECT s.size, c.make, c.model, c.doc_order FROM (SELECT CAST(range AS BIGINT) AS size FROM range(0, 60)) s LEFT JOIN chdk c USING (size)""")
def jon03_camera_by_file_size(spark, sf_dir):
    sizes = spark.range(0, 60).withColumnRenamed("id", "size")
    return C.by_file_size(sizes, cams(spark, sf_dir)).selectExpr("size", "camera.make", "camera.model", "camera.doc_order")


WITHIN = """picks AS (SELECT t.*, s.ord, s.black, s.white, row_number() OVER (PARTITION BY t.make, t.model, t.iso ORDER BY (s.iso_min = 0 AND s.iso_max = 0), s.ord) AS r
  FROM (SELECT DISTINCT trim(make, ' ' || chr(9)) AS make, model, iso FROM shots) t LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY make, model) AS cnt FROM sensors) s
  ON t.make = s.make AND t.model = s.model AND (cnt = 1 OR (t.iso >= iso_min AND (t.iso <= iso_max OR iso_max = 0)))), levels AS (SELECT make, model, iso, ord, black, white FROM picks WHERE r = 1)"""


def levels(spark, sf_dir):
    """Levels are chosen once for each (camera, sensitivity), not for each shot."""
    kinds = X.shots(spark, sf_dir).select(C.trimmed("make").alias("make"), "model", "iso").distinct()
    return C.sensor_by_kind(kinds, X.sensors(spark, sf_dir)).selectExpr("make", "model", "iso", "sensor.ord", "sensor.black", "sensor.white")


@query(f"WITH {X.SHOTS}, {X.SENSORS}, {WITHIN} SELECT make, model, iso, ord, black, white FROM levels")
def jon04_sensor_by_sensitivity(spark, sf_dir):
    return levels(spark, sf_dir)


@query(f"""{CTE}, dng AS (SELECT make, model, doc_order FROM cams WHERE mode = 'dng'), plain AS (SELECT make, model, doc_order FROM cams WHERE mode = ''),
anym AS (SELECT make, model, arg_min(doc_order, mode) AS doc_order FROM cams GROUP BY ALL)
SELECT {TRIM.format('s.make')} AS maker, count(*) AS n, CAST(sum(coalesce(d.doc_order, p.doc_order, a.doc_order)) AS BIGINT) AS order_sum FROM shots s
LEFT JOIN dng d ON {ON.replace('c.', 'd.')} LEFT JOIN plain p ON {ON.replace('c.', 'p.')} LEFT JOIN anym a ON {ON.replace('c.', 'a.')} GROUP BY ALL""")
def jon14_dng_fallbacks(spark, sf_dir):
    found = C.with_fallbacks(X.shots(spark, sf_dir), cams(spark, sf_dir), ("dng", "", "*"), "doc_order")
    return found.groupBy(C.trimmed("make").alias("maker")).agg(F.count("*").alias("n"), F.sum("doc_order").alias("order_sum"))


@query(f"""{CTE}, plain AS (SELECT make, model, doc_order FROM cams WHERE mode = '')
SELECT s.mode, count(*) AS n, CAST(sum(coalesce(c.doc_order, p.doc_order)) AS BIGINT) AS order_sum FROM shots s
LEFT JOIN cams c ON {ON} AND s.mode = c.mode LEFT JOIN plain p ON {ON.replace('c.', 'p.')} GROUP BY ALL""")
def jon15_mode_fallback(spark, sf_dir):
    found = C.with_fallbacks(X.shots(spark, sf_dir), cams(spark, sf_dir), (None, ""), "doc_order")
    return found.groupBy("mode").agg(F.count("*").alias("n"), F.sum("doc_order").alias("order_sum"))


STATUS = "CASE size % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'no-samples' WHEN 3 THEN 'unknown' ELSE '' END"


@query(f"""WITH {X.CAMERAS}, {DEDUP}, t AS (SELECT *, CASE WHEN dropped > 5 THEN NULL ELSE {STATUS} END AS status FROM cams)
SELECT make, model, mode, CASE WHEN status IN ('', 'supported', 'no-samples') THEN true WHEN status = 'unsupported' THEN NULL ELSE status IS NOT NULL END AS verdict,
 (status IS NOT NULL AND status = 'no-samples') OR ((status IS NULL OR status = 'unknown') AND mode <> 'dng') AS no_samples FROM t""")
def flt07_support_verdict(spark, sf_dir):
    t = cams(spark, sf_dir).withColumn("status", F.expr(f"IF(dropped > 5, NULL, {STATUS})"))
    return C.support(t, "status", "mode").select("make", "model", "mode", "verdict", "no_samples")


@query(f"WITH {X.CAMERAS}, {DEDUP} SELECT make, count(*) AS n FROM cams WHERE size % 7 <= 3 GROUP BY make")
def flt08_decoder_version_gate(spark, sf_dir):
    t = cams(spark, sf_dir).withColumn("decoder_version", F.expr("size % 7"))
    return C.version_gate(t, 3).groupBy("make").agg(F.count("*").alias("n"))


@query(f"WITH {X.CAMERAS}, {DEDUP} SELECT make, model, mode, CASE WHEN make = 'Brand#11' OR (make = 'Brand#22' AND model = (SELECT min(model) FROM cameras)) THEN 'unsupported' ELSE 'supported' END AS status FROM cams")
def flt09_disable_cameras(spark, sf_dir):
    t = cams(spark, sf_dir).withColumn("status", F.lit("supported"))
    model = X.cameras(spark, sf_dir).agg(F.min("model")).first()[0]
    return C.disable(C.disable(t, "Brand#11"), "Brand#22", model).select("make", "model", "mode", "status")


@query(f"WITH {X.CAMERAS} SELECT make, model, list_sort(list(DISTINCT mode)) AS modes, count(DISTINCT mode) AS n_modes, count(*) AS n_entries FROM cameras GROUP BY ALL")
def agg10_modes_by_camera(spark, sf_dir):
    return C.models_by_make(X.cameras(spark, sf_dir))


HINTS = "IF(size % 3 = 0, map('flag', 'true', 'n', cast(size AS string), 'e', ''), map('flag', 'TRUE', 'n', 'many'))"


@query(f"WITH {X.CAMERAS} SELECT doc_order, size % 3 = 0 AS flag, CASE WHEN size % 3 = 0 THEN size ELSE -1 END AS n, CAST(7 AS BIGINT) AS e, false AS missing FROM cameras")
def fn20_typed_hints(spark, sf_dir):
    t = X.cameras(spark, sf_dir).withColumn("hints", F.expr(HINTS))
    return t.select("doc_order", C.hint("hints", "flag", "boolean", False).alias("flag"), C.hint("hints", "n", "bigint", -1).alias("n"), C.hint("hints", "e", "bigint", 7).alias("e"), C.hint("hints", "no", "boolean", False).alias("missing"))


FLAG = f"""WITH {X.CAMERAS}, {DEDUP}, {X.SHOTS}, {X.SENSORS}, {WITHIN},
t AS (SELECT s.*, l.black, l.white FROM (SELECT *, {TRIM.format('make')} AS mk FROM shots) s JOIN (SELECT DISTINCT make, model FROM cams) c ON s.mk = c.make AND s.model = c.model
  JOIN levels l ON s.mk = l.make AND s.model = l.model AND s.iso = l.iso WHERE s.x >= 4 AND s.x < 96 AND s.y >= 2 AND s.y < 98),
o AS (SELECT mk AS make, greatest(0, least(65535, ((v - black) * CAST(trunc(CAST(1073725440.0::DOUBLE / (white - black) AS FLOAT)) AS BIGINT) + 8192) >> 14)) AS v FROM t)
SELECT make, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v) AS DOUBLE) / count(*) AS mean, min(v) AS low, max(v) AS high FROM o GROUP BY make"""


@query(FLAG)
def flagship_levels_by_family(spark, sf_dir):
    """Samples of the active area, scaled by the levels of their camera and sensitivity, summed up by maker."""
    names = C.any_mode(cams(spark, sf_dir)).select("make", "model", "mode", "doc_order")
    area = G.relative_crop(4, 2, -4, -2, 100, 100)
    shots = C.look_up(G.inside(X.shots(spark, sf_dir), area), names, ("make", "model")).filter("doc_order IS NOT NULL").withColumn("make", C.trimmed("make"))
    shots = C.choose_sensor(shots.select("make", "model", "iso", "v"), X.sensors(spark, sf_dir))
    scaled = shots.withColumn("v", P.scaled_u16(F.col("v"), F.col("sensor.black"), F.col("sensor.white")))
    return scaled.groupBy("make").agg(F.count("*").alias("n"), F.sum("v").alias("total"), (F.sum("v").cast("double") / F.count("*")).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
