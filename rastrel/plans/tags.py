"""Queries on tag trees and on the choice of decoders."""

from pyspark.sql import functions as F

from ..operators import tags as T
from ..registry import query
from . import fixtures as X

TAGS = f"WITH {X.TAGS}, e AS (SELECT file_id, ifd, tag, arg_max(dfs, (dfs, num)) AS dfs, arg_max(kind, (dfs, num)) AS kind, arg_max(num, (dfs, num)) AS num FROM tags GROUP BY ALL)"


def entries(spark, sf_dir):
    return T.last_entry_wins(X.tags(spark, sf_dir))


@query(f"WITH {X.TAGS} SELECT file_id, ifd, tag, max(dfs) AS dfs, max(struct_pack(d := dfs, n := num)).n AS num FROM tags GROUP BY ALL")
def src07_last_entry_wins(spark, sf_dir):
    return entries(spark, sf_dir).select("file_id", "ifd", "tag", "dfs", "num")


PLACES = f"{TAGS}, p AS (SELECT file_id, ifd, dfs, row_number() OVER (PARTITION BY file_id ORDER BY dfs, ifd) - 1 AS place FROM (SELECT file_id, ifd, min(dfs) AS dfs FROM e WHERE tag = 256 GROUP BY ALL))"


@query(f"{PLACES} SELECT * FROM p")
def flt01_directories_with_tag(spark, sf_dir):
    return T.directories_with(entries(spark, sf_dir), 256)


@query(f"{PLACES} SELECT file_id, ifd, dfs FROM p WHERE place = 1")
def flt02_second_directory_with_tag(spark, sf_dir):
    return T.directory_with(entries(spark, sf_dir), 256, 1)


@query(f"{TAGS}, f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY dfs, ifd, num) AS r FROM e WHERE tag = 258) SELECT file_id, ifd, kind, num FROM f WHERE r = 1")
def flt03_first_entry(spark, sf_dir):
    return T.first_entry(entries(spark, sf_dir), 258)


@query(f"{TAGS} SELECT o_orderkey AS file_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT file_id FROM e WHERE tag = 259)")
def flt04_has_entry(spark, sf_dir):
    files = X.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", "o_orderstatus AS status")
    return T.with_tag(files, entries(spark, sf_dir), 259)


@query(f"{TAGS} SELECT DISTINCT file_id, ifd FROM e WHERE tag = 260 AND num = 7 OR tag = 260 AND kind = 2")
def flt05_directories_where(spark, sf_dir):
    return T.directories_where(entries(spark, sf_dir), 260, (F.col("num") == 7) | (F.col("kind") == 2))


@query(f"{TAGS} SELECT file_id, ifd, tag, num, dfs FROM e WHERE (num & 5) = 0 AND dfs % 10 IN (1, 7, 8, 9)")
def flt06_usable_chunks(spark, sf_dir):
    t = entries(spark, sf_dir).withColumn("compression", F.expr("dfs % 10"))
    return T.usable_chunks(t, "num").select("file_id", "ifd", "tag", "num", "dfs")


@query(f"{TAGS} SELECT kind, kind IN (1, 3, 4, 6, 8, 9, 13) AS is_int, kind IN (1, 3, 4, 6, 8, 9, 13, 11, 12, 5, 10) AS is_float, kind IN (1, 3, 4, 6, 8, 9, 13, 5, 10) AS is_rational, kind = 2 AS is_string, count(*) AS n FROM e GROUP BY kind")
def flt13_kind_predicates(spark, sf_dir):
    t = entries(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return t.select("kind", *[c.alias(n) for n, c in T.kind_flags().items()], "n")


@query(f"{TAGS}, t AS (SELECT *, dfs * 100 AS b, 8 + kind AS bits, 10 + num AS w, 5 + tag % 9 AS h FROM e), s AS (SELECT *, (b * 8) // bits AS samples, b - (w * h * bits) // 8 AS spare FROM t) SELECT file_id, ifd, tag, samples = w * h OR (samples > w * h AND spare % h = 0 AND spare // h < 16) AS plain, (b * 8) // (w * h) < bits AS packed FROM s")
def flt14_uncompressed_guess(spark, sf_dir):
    t = entries(spark, sf_dir).selectExpr("file_id", "ifd", "tag", "dfs * 100 AS b", "8 + kind AS bits", "10 + num AS w", "5 + tag % 9 AS h")
    c = [F.col(x) for x in ("b", "bits", "w", "h")]
    return t.select("file_id", "ifd", "tag", T.nef_uncompressed(*c).alias("plain"), T.raf_compressed(*c).alias("packed"))


@query("SELECT user_id AS file_id, count(*) AS n, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id HAVING count(*) >= 3")
def flt16_too_many_errors(spark, sf_dir):
    return T.has_too_many_errors(X.table(spark, sf_dir, "events").selectExpr("user_id AS file_id", "event_id AS ord", "event_type AS message"), 3)


@query(f"{TAGS}, f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY num DESC, dfs, ifd) AS r FROM e WHERE tag = 256) SELECT file_id, ifd, num FROM f WHERE r = 1")
def srt02_largest_image(spark, sf_dir):
    return T.largest_image(entries(spark, sf_dir), 256)


MAKES = "CASE p_partkey % 9 WHEN 0 THEN ' Canon' WHEN 1 THEN 'NIKON CORPORATION' WHEN 2 THEN 'SONY' WHEN 3 THEN 'Leaf' WHEN 4 THEN 'Phase One' WHEN 5 THEN 'Kodak' WHEN 6 THEN 'Panasonic' WHEN 7 THEN 'nobody' ELSE NULL END"


@query(f"""WITH t AS (SELECT p_partkey AS file_id, trim({MAKES}, ' ' || chr(9)) AS make, CASE WHEN p_size > 25 THEN 'DCS520C' ELSE p_type END AS model, p_size % 11 = 0 AS dng, p_size % 2 = 0 AS magic, CASE WHEN p_size < 20 THEN 'Camera Library 2' END AS software FROM part)
SELECT file_id, CASE WHEN dng THEN 'DNG' WHEN (make = 'Leaf' AND NOT magic) OR (make IS NULL AND starts_with(software, 'Camera Library')) THEN 'MOS' WHEN magic AND make IN ('Phase One', 'Leaf') THEN 'IIQ'
 WHEN make = 'Kodak' AND model = 'DCS520C' THEN 'CR2' WHEN make = 'Canon' THEN 'CR2' WHEN make = 'NIKON CORPORATION' THEN 'NEF' WHEN make = 'SONY' THEN 'ARW' WHEN make = 'Panasonic' THEN 'RW2' WHEN make = 'Kodak' THEN 'DCR' END AS decoder FROM t""")
def dec01_to_17_decoder_choice(spark, sf_dir):
    t = X.table(spark, sf_dir, "part").selectExpr("p_partkey AS file_id", f"{MAKES} AS make", "IF(p_size > 25, 'DCS520C', p_type) AS model", "p_size % 11 = 0 AS dng", "p_size % 2 = 0 AS magic", "IF(p_size < 20, 'Camera Library 2', NULL) AS software")
    return t.select("file_id", T.decoder(*[F.col(c) for c in ("make", "model", "dng", "magic", "software")]).alias("decoder"))


HEADS = "CASE event_id % 7 WHEN 0 THEN '004D524D' WHEN 1 THEN '46554A4946494C4D' WHEN 2 THEN '49492A00' WHEN 3 THEN '4D4D002A' WHEN 4 THEN '49491A0000004845415043434452' WHEN 5 THEN '00000000' ELSE '4949524F' END"


@query("""SELECT event_id AS file_id, CASE WHEN user_id <= 4 THEN 'too small' ELSE CASE event_id % 7 WHEN 0 THEN 'MRW' WHEN 1 THEN 'RAF' WHEN 4 THEN 'CIFF' WHEN 5 THEN CASE WHEN event_id % 2 = 0 THEN 'naked' END ELSE 'TIFF' END END AS kind FROM events""")
def src05_format_dispatch(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").selectExpr("event_id AS file_id", "100 + user_id AS size", f"unhex({HEADS}) AS head", "event_id % 2 = 0 AS chdk")
    return t.select("file_id", T.file_kind(F.col("size"), F.col("head"), F.col("chdk")).alias("kind"))


@query("SELECT event_id AS file_id, event_id % 4 = 2 AND user_id % 3 = 0 OR event_id % 4 = 3 AS first_rule, CASE WHEN event_id % 4 = 0 THEN 'a' WHEN event_id % 3 = 0 THEN 'b' WHEN event_id % 2 = 0 THEN 'c' END AS pick FROM events")
def srt03_first_match_wins(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    pick = T.first_match([("a", F.expr("event_id % 4 = 0")), ("b", F.expr("event_id % 3 = 0")), ("c", F.expr("event_id % 2 = 0"))])
    return e.select(F.col("event_id").alias("file_id"), F.expr("event_id % 4 = 2 AND user_id % 3 = 0 OR event_id % 4 = 3").alias("first_rule"), pick.alias("pick"))


@query("""WITH t AS (SELECT event_id, CAST(100 + event_id % 200 AS DOUBLE) / (100 + user_id % 50) AS r FROM events), d AS (SELECT event_id, unnest([struct_pack(d := abs(r - 16 / 9.0::DOUBLE), i := 0, n := '16:9'), struct_pack(d := abs(r - 1.5::DOUBLE), i := 1, n := '3:2'), struct_pack(d := abs(r - 4 / 3.0::DOUBLE), i := 2, n := '4:3'), struct_pack(d := abs(r - 1.0::DOUBLE), i := 3, n := '1:1')]) AS s FROM t)
SELECT event_id, min(s).n AS ratio FROM d GROUP BY event_id""")
def srt04_nearest_aspect_ratio(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", T.nearest_ratio(F.expr("100 + event_id % 200"), F.expr("100 + user_id % 50")).alias("ratio"))


@query("WITH t AS (SELECT user_id, event_id % 11 AS v, event_id AS j FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v, j DESC) AS place FROM t) SELECT user_id, place, j, v FROM r")
def srt05_last_least_first(spark, sf_dir):
    t = X.table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 11 AS v", "event_id AS j")
    return t.selectExpr("user_id", "cast(row_number() OVER (PARTITION BY user_id ORDER BY v, j DESC) AS bigint) AS place", "j", "v")


@query("SELECT event_id, event_type IN ('click', 'view', 'purchase') AS known, user_id IN (1, 2, 3) AS few FROM events")
def set05_is_in(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("click", "view", "purchase").alias("known"), F.col("user_id").isin(1, 2, 3).alias("few"))


@query("""WITH l AS (SELECT doc_id, sha1(text) || '  ' || source || '/' || doc_id || '.raw' AS line FROM documents UNION ALL SELECT doc_id, left(text, 30) FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, substr(line, 1, 40) AS sha1, substr(line, 43) AS name, 'root/' || substr(line, 43) AS full_name FROM l WHERE length(line) > 42""")
def src04_checksum_manifest(spark, sf_dir):
    from ..sources.manifest import parsed

    d = X.table(spark, sf_dir, "documents")
    own = d.selectExpr("doc_id", "concat(sha1(text), '  ', source, '/', cast(doc_id AS string), '.raw') AS value")
    short = d.filter("doc_id % 10 = 0").selectExpr("doc_id", "left(text, 30) AS value")
    return parsed(own.union(short), "root").filter("error IS NULL").select("doc_id", "sha1", "name", "full_name")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, max(l_partkey) AS count, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, l_suppkey, count * 8 <> l_suppkey * 16 * 12 AS arw1,
 CASE WHEN count * 8 <> l_suppkey * 16 * 12 THEN 24 ELSE 16 END AS height, CASE WHEN l_linenumber = 2 THEN 8 ELSE 12 END AS bits FROM t""")
def fn35_variant_choice(spark, sf_dir):
    from ..operators.variants import arw_variant

    t = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_partkey").alias("count"))
    v = arw_variant(F.col("count"), F.col("l_suppkey"), F.lit(16), F.lit(12), F.col("l_linenumber") == 2)
    return t.select("l_orderkey", "l_linenumber", "l_suppkey", v["arw1"].alias("arw1"), v["height"].alias("height"), v["bits"].alias("bits"))


@query("""SELECT event_id AS file_id, list_transform(CASE event_id % 5
 WHEN 0 THEN [CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 1.0::DOUBLE / (user_id % 3) END, 1.0 / (1 + user_id), 0.5]
 WHEN 1 THEN [1.0::DOUBLE / (0.5 * (0.25::DOUBLE / 0.5) + 0.25 + 0.125 * ((1 - 0.25::DOUBLE - 0.5) / 0.5)), 1.0::DOUBLE / 2, 1.0::DOUBLE / (4 * ((1 - 0.25::DOUBLE - 0.5) / 0.5))]
 WHEN 2 THEN [user_id, user_id + 1, user_id + 3] WHEN 3 THEN [user_id - 10, user_id - 10, user_id - 10] ELSE [user_id, 256.0, event_id] END, lambda v: round(v::DOUBLE, 9)) AS wb FROM events""")
def fn29_white_balance(spark, sf_dir):
    """Five makers' ways to give it, as entries of files."""
    from ..operators import balance as W

    e = X.table(spark, sf_dir, "events")
    rows = lambda k, tag, numbers: e.filter(f"event_id % 5 = {k}").selectExpr("event_id AS file_id", f"{tag} AS tag", f"cast({numbers} AS array<double>) AS numbers")
    parts = [
        rows(0, W.NEUTRAL, "array(user_id % 3, 1 + user_id, 2)"), rows(1, W.WHITE_XY, "array(0.25, 0.5)"), rows(2, W.LEVELS, "array(user_id, user_id + 1, user_id + 2, user_id + 3)"),
        rows(3, W.UNCORRECTED, "array(user_id, user_id + 1, user_id + 2, user_id + 3)"), rows(3, W.BLACKS, "array(10, 11, 12, 13)"), rows(4, W.RED, "array(user_id)"), rows(4, W.BLUE, "array(event_id)"), rows(4, 271, "array(1)"),
    ]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    matrix = F.array(*[F.lit(v) for v in (0.5, 0.25, 0.125, 0.0, 2.0, 0.0, 0.0, 0.0, 4.0)])
    return W.white_balance(entries, matrix).select("file_id", F.transform("wb", lambda v: F.round(v, 9)).alias("wb"))
