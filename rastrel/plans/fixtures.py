"""Rasters, a device catalog and shots, read from the given tables; and the same as SQL, for the oracles.

events: event_id runs 0..n-1, so 1000 of them fill an image of 20 x 50 (or 25 x 40) samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, AREA = 50, 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane_u16(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """(image_id, y, x, v): 16-bit samples."""
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {AREA} AS image_id", f"(event_id % {AREA}) div {width} AS y", f"event_id % {AREA} % {width} AS x", "cast(round(value * 100) AS bigint) AS v"
    )


def plane_sql(width: int = WIDTH) -> str:
    return f"plane AS (SELECT event_id // {AREA} AS image_id, (event_id % {AREA}) // {width} AS y, event_id % {AREA} % {width} AS x, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def plane_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): float samples, 32 rows of 64 an image."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return rows.selectExpr("vec_id div 32 AS image_id", "vec_id % 32 AS y", "cast(x AS bigint) AS x", "v")


PLANE_F32 = "fplane AS (SELECT vec_id // 32 AS image_id, vec_id % 32 AS y, CAST(x - 1 AS BIGINT) AS x, embedding[x] AS v FROM embeddings, unnest(range(1, 65)) t(x))"


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_order, make, model, mode, size): catalog entries in file order, many of them twice."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_order", "p_brand AS make", "p_type AS model", "IF(p_partkey % 5 = 0, 'chdk', '') AS mode", "cast(p_size AS bigint) AS size")


CAMERAS = "cameras AS (SELECT p_partkey AS doc_order, p_brand AS make, p_type AS model, CASE WHEN p_partkey % 5 = 0 THEN 'chdk' ELSE '' END AS mode, CAST(p_size AS BIGINT) AS size FROM part)"


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(make, model, ord, black, white, iso_min, iso_max): levels by sensitivity; the first of a camera is its default."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS make", "p_type AS model", "row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k", "cast(p_size AS bigint) AS size"
    ).selectExpr(
        "make", "model", "cast(k AS bigint) AS ord", "size AS black", "4095 + size AS white", "IF(k = 1, 0L, size * 50) AS iso_min", "IF(k = 1 OR k % 4 = 0, 0L, size * 50 + 400) AS iso_max"
    )


SENSORS = """sensors AS (SELECT make, model, k AS ord, size AS black, 4095 + size AS white, CASE WHEN k = 1 THEN 0 ELSE size * 50 END AS iso_min,
    CASE WHEN k = 1 OR k % 4 = 0 THEN 0 ELSE size * 50 + 400 END AS iso_max
  FROM (SELECT p_brand AS make, p_type AS model, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k, CAST(p_size AS BIGINT) AS size FROM part))"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, make, model, mode, iso, x, y, v): samples with the names that their files give, padded with blanks or wrong at times."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "p_type")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey AS order_id", "concat(' ', p_brand, '\t') AS make", "IF(l_linenumber = 7, concat(p_type, 'x'), p_type) AS model", "IF(l_suppkey % 3 = 0, 'chdk', '') AS mode",
        "cast(l_quantity AS bigint) * 50 AS iso", "l_partkey % 100 AS x", "l_suppkey % 100 AS y", "cast(round(l_extendedprice) AS bigint) % 65536 AS v",
    )


SHOTS = """shots AS (SELECT l_orderkey AS order_id, ' ' || p_brand || chr(9) AS make, CASE WHEN l_linenumber = 7 THEN p_type || 'x' ELSE p_type END AS model,
    CASE WHEN l_suppkey % 3 = 0 THEN 'chdk' ELSE '' END AS mode, CAST(l_quantity AS BIGINT) * 50 AS iso, l_partkey % 100 AS x, l_suppkey % 100 AS y, CAST(round(l_extendedprice) AS BIGINT) % 65536 AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, ord, s, e): half-open ranges of seconds, in the order they were inserted."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS grp", "event_id AS ord", "unix_seconds(cast(ts AS timestamp)) AS s", "unix_seconds(cast(ts AS timestamp)) + cast(floor(value) AS bigint) * 40 AS e")


RANGES = "ranges AS (SELECT user_id AS grp, event_id AS ord, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) * 40 AS e FROM events)"


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n, off, len): strips of a file in stored order."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS file_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n", "unix_millis(cast(ts AS timestamp)) AS off", "cast(round(value * 100) AS bigint) AS len").withColumn("n", F.col("n").cast("long"))


STRIPS = "strips AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, epoch_us(ts) // 1000 AS off, CAST(round(value * 100) AS BIGINT) AS len FROM events)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, ifd, dfs, tag, kind, num): entries of tag trees; a later entry of a directory's tag replaces an earlier one."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q")).selectExpr(
        "l_orderkey AS file_id", "cast(l_linenumber AS bigint) AS ifd", "l_suppkey AS dfs", "254 + p % 12 AS tag", "p % 13 AS kind", "cast(q AS bigint) AS num"
    )


TAGS = """tags AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS ifd, l_suppkey AS dfs, 254 + p % 12 AS tag, p % 13 AS kind, CAST(q AS BIGINT) AS num
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, max(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): the bytes of each text, padded with zeros to rows of 48."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS raw")
    return d.selectExpr("doc_id", "rpad(raw, cast(ceil(length(raw) / 48) * 48 AS int), X'00') AS data")
