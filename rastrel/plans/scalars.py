"""Queries of scalar functions over columns of the given tables."""

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import cfa, curves, floats, text
from ..operators.pixels import table_column
from ..registry import query
from . import fixtures as X

E = "CAST(floor(value * 1000) AS BIGINT)"


def ev(spark, sf_dir):
    return X.table(spark, sf_dir, "events").selectExpr("event_id AS id", "cast(floor(value * 1000) AS bigint) AS v", "user_id AS u", "event_type AS s")


@query(f"SELECT event_id AS id, greatest(0, least(4095, {E} - 5000)) AS v FROM events")
def fn01_clamp_bits(spark, sf_dir):
    return ev(spark, sf_dir).select("id", B.clamp_bits(F.col("v") - 5000, 12).alias("v"))


@query(f"SELECT event_id AS id, {E} BETWEEN 0 AND 65535 AS fits FROM events")
def fn02_is_int_n(spark, sf_dir):
    return ev(spark, sf_dir).select("id", B.is_int_n(F.col("v"), 16).alias("fits"))


@query(f"SELECT event_id AS id, {E} & 1023 AS low, CAST(0 AS BIGINT) AS none FROM events")
def fn03_low_bits(spark, sf_dir):
    return ev(spark, sf_dir).select("id", B.extract_low_bits(F.col("v"), 10).alias("low"), B.extract_low_bits(F.col("v"), 0).alias("none"))


@query(f"SELECT event_id AS id, ({E} & 65535) >> 9 AS high FROM events")
def fn04_high_bits(spark, sf_dir):
    return ev(spark, sf_dir).select("id", B.extract_high_bits(F.col("v").bitwiseAND(F.lit(65535)), 7, 16).alias("high"))


@query(f"SELECT event_id AS id, CASE WHEN ({E} & 4095) >= 2048 THEN ({E} & 4095) - 4096 ELSE {E} & 4095 END AS v FROM events")
def fn05_sign_extend(spark, sf_dir):
    return ev(spark, sf_dir).select("id", B.sign_extend(F.col("v"), 12).alias("v"))


@query(f"SELECT event_id AS id, CASE WHEN n = 0 THEN 0 WHEN v < (1 << greatest(n - 1, 0)) THEN v - (1 << n) + 1 ELSE v END AS d FROM (SELECT event_id, user_id % 13 AS n, {E} & ((1 << (user_id % 13)) - 1) AS v FROM events)")
def fn06_extend_difference(spark, sf_dir):
    t = ev(spark, sf_dir).selectExpr("id", "u % 13 AS n", "v & (shiftleft(1L, cast(u % 13 AS int)) - 1) AS v")
    return t.select("id", B.extend(F.col("v"), F.col("n")).alias("d"))


@query(f"SELECT event_id AS id, {E} & -{E} = {E} AS power, CASE WHEN {E} = 0 THEN 0 ELSE length(bin({E})) END AS bits FROM events")
def fn07_powers_and_lengths(spark, sf_dir):
    t = ev(spark, sf_dir)
    return t.select("id", B.is_power_of_two(F.col("v")).alias("power"), B.active_bits(F.col("v")).cast("long").alias("bits"))


@query(f"SELECT event_id AS id, {E} - {E} % 16 AS down, ({E} + 15) // 16 * 16 AS up, {E} AS same, CASE WHEN {E} = 0 THEN 0 ELSE 1 + ({E} - 1) // 10 END AS parts, {E} % 4 = 0 AS aligned FROM events")
def fn08_rounding(spark, sf_dir):
    v = F.col("v")
    return ev(spark, sf_dir).select("id", B.round_down(v, 16).alias("down"), B.round_up(v, 16).alias("up"), B.round_up(v, 0).alias("same"), B.round_up_division(v, 10).alias("parts"), B.is_aligned(v, 4).alias("aligned"))


@query("SELECT event_id AS id, trim(s, ' ' || chr(9)) AS t FROM (SELECT event_id, ' ' || chr(9) || event_type || ' x' || chr(10) || ' ' AS s FROM events)")
def fn09_trim_spaces(spark, sf_dir):
    return ev(spark, sf_dir).select("id", text.trim_spaces(F.concat(F.lit(" \t"), F.col("s"), F.lit(" x\n "))).alias("t"))


@query("SELECT doc_id, list_filter(string_split(text, ' '), lambda t: t <> '') AS parts FROM documents")
def fn10_split_string(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.split_string(F.col("text")).alias("parts"))


@query(f"SELECT event_id AS id, (v & 255) * 16777216 + ((v >> 8) & 255) * 65536 + ((v >> 16) & 255) * 256 + ((v >> 24) & 255) AS be, v AS le, (v & 255) * 256 + ((v >> 8) & 255) AS be16 FROM (SELECT event_id, {E} AS v FROM events)")
def fn11_byte_order(spark, sf_dir):
    t = ev(spark, sf_dir).withColumn("data", F.unhex(F.lpad(F.hex("v"), 8, "0")))
    le = t.withColumn("data", F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex("data"), F.lit("(..)"), 1)), "")))
    d = F.col("data")
    return le.select("id", B.number(d, 0, 4, big=True).alias("be"), B.number(d, 0, 4).alias("le"), B.number(d, 0, 2, big=True).alias("be16"))


WIDE = "CASE WHEN e = {top} THEN CASE WHEN f = 0 THEN s * CAST('infinity' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END WHEN e = 0 THEN s * (f * {tiny}::DOUBLE) ELSE s * (pow(2.0::DOUBLE, e - {bias}) * (f / {one}::DOUBLE + 1)) END"


def _wide(e, f, n):
    bias, top = (1 << e - 1) - 1, (1 << e) - 1
    return f"(SELECT event_id, CASE WHEN (v >> {e + f}) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, (v >> {f}) & {top} AS e, CAST(v & {(1 << f) - 1} AS DOUBLE) AS f FROM (SELECT event_id, ({E} * 48271) & {(1 << n) - 1} AS v FROM events))", WIDE.format(top=top, bias=bias, one=1 << f, tiny=repr(2.0 ** (1 - bias - f)))


H, HX = _wide(5, 10, 16)
T3, TX = _wide(7, 16, 24)


@query(f"SELECT h.event_id AS id, CAST({HX} AS VARCHAR) = 'nan' AS nan16, CASE WHEN e = 31 THEN 0 ELSE round({HX}, 12) END AS f16 FROM {H} h")
def fn12_half_floats(spark, sf_dir):
    t = ev(spark, sf_dir).select("id", floats.half((F.col("v") * 48271).bitwiseAND(F.lit(65535))).alias("f"))
    return t.select("id", F.isnan("f").alias("nan16"), F.when(F.isnan("f") | (F.abs("f") == float("inf")), 0.0).otherwise(F.round("f", 12)).alias("f16"))


@query(f"SELECT event_id AS id, CASE WHEN e = 127 THEN 0 ELSE round({TX}, 9) END AS f24 FROM {T3} t")
def cdc02_three_byte_floats(spark, sf_dir):
    t = ev(spark, sf_dir).select("id", floats.three_bytes((F.col("v") * 48271).bitwiseAND(F.lit((1 << 24) - 1))).alias("f"))
    return t.select("id", F.when(F.isnan("f") | (F.abs("f") == float("inf")), 0.0).otherwise(F.round("f", 9)).alias("f24"))


@query("SELECT event_id % 65536 AS v, count(*) AS n FROM events GROUP BY ALL")
def fn13_identity_spline(spark, sf_dir):
    """The spline through both corners is the identity."""
    t = X.table(spark, sf_dir, "events").select((F.col("event_id") % 65536).alias("v"))
    return t.groupBy(curves.spline_at(F.col("v"), [(0, 0), (65535, 65535)]).alias("v")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, CASE (event_id + 1) % 2 + 2 * ((event_id + 3) % 2) WHEN 0 THEN 'RED' WHEN 3 THEN 'BLUE' ELSE 'GREEN' END AS c, 'GREEN,RED' || chr(10) || 'BLUE,GREEN' || chr(10) AS s FROM events")
def fn14_filter_pattern(spark, sf_dir):
    p = cfa.pattern(["RED", "GREEN", "GREEN", "BLUE"])
    return ev(spark, sf_dir).select("id", cfa.at(cfa.shifted(p, 2, 2, 1, 1), 2, 2, F.col("id"), F.col("id") + 2).alias("c"), cfa.as_text(cfa.shifted(p, 2, 2, 1, 0), 2, 2).alias("s"))


@query("SELECT event_id AS id, CAST(2492765332 AS BIGINT) AS rggb, CAST(1633771873 AS BIGINT) AS moved, CAST(9 AS BIGINT) AS six FROM events")
def fn15_packed_filter(spark, sf_dir):
    f = cfa.packed_filter(cfa.pattern(["RED", "GREEN", "GREEN", "BLUE"]), 2, 2)
    return ev(spark, sf_dir).select("id", f.alias("rggb"), cfa.shifted_filter(f, 1, 0).alias("moved"), cfa.packed_filter(cfa.pattern(["RED"] * 36), 6, 6).alias("six"))


@query("SELECT event_id AS id, 'GRBG' AS phase, [v + 1, v, v + 3, v + 2] AS moved, [v + 2, v + 3, v, v + 1] AS plain, [v + 2, v + 3, v, v + 1][1] AS first, [v + 3, v + 2, v + 1, v] AS both, [v + 3, v + 1, v + 2, v] AS kept FROM (SELECT event_id, user_id AS v FROM events)")
def fn16_bayer_phases(spark, sf_dir):
    d = F.expr("array(u, u + 1, u + 2, u + 3)")
    return ev(spark, sf_dir).select(
        "id", cfa.bayer_phase(cfa.pattern(["GREEN", "RED", "BLUE", "GREEN"])).alias("phase"), cfa.rephased(d, "RGGB", "GRBG").alias("moved"), cfa.rephased(d, "RGGB", "GBRG").alias("plain"),
        F.get(cfa.rephased(d, "GBRG", "RGGB"), F.lit(0)).alias("first"), cfa.rephased(d, "RGGB", "BGGR").alias("both"), cfa.rephased(d, "RGGB", "BGGR", keep_greens=True).alias("kept"),
    )


@query("SELECT event_id AS id, CAST(event_id % 3 + CASE WHEN event_id % 6 >= 3 THEN 3 ELSE 0 END AS INTEGER) AS x, CAST(event_id % 3 AS INTEGER) AS y FROM events WHERE event_id < 36")
def fn17_six_by_six_phase(spark, sf_dir):
    rows = [(i, cfa.xtrans(i % 3, i % 6)) for i in range(36)]
    t = spark.createDataFrame(rows, "id long, cfa array<string>")
    p = cfa.xtrans_phase(F.col("cfa"))
    return t.select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN 0.0::DOUBLE ELSE event_id / (user_id % 5)::DOUBLE END AS r FROM events")
def fn18_rationals(spark, sf_dir):
    return ev(spark, sf_dir).select("id", floats.rational(F.col("id"), F.expr("u % 5")).alias("r"))


@query("SELECT event_id AS id, CASE WHEN c < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CAST(abs(c) - abs(c) % 32 + CASE abs(c) % 32 WHEN 12 THEN 10 WHEN 20 THEN 21 ELSE abs(c) % 32 END AS DOUBLE) / 32 AS ev FROM (SELECT event_id, event_id % 200 - 100 AS c FROM events)")
def fn19_canon_ev(spark, sf_dir):
    return ev(spark, sf_dir).select("id", text.canon_ev(F.expr("id % 200 - 100")).alias("ev"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'FUJI_GREEN' END AS letter, CASE WHEN event_id % 2 = 0 THEN 'MAGENTA' END AS word FROM events")
def fn21_color_names(spark, sf_dir):
    t = ev(spark, sf_dir)
    return t.select("id", text.color_letter(F.expr("CASE id % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'f' ELSE 'x' END")).alias("letter"), text.color_word(F.expr("IF(id % 2 = 0, 'MAGENTA', 'magenta')")).alias("word"))


@query("SELECT event_id AS id, [event_id / 10000.0::DOUBLE, -user_id / 10000.0::DOUBLE, 0.7::DOUBLE] AS m FROM events")
def fn22_color_matrix(spark, sf_dir):
    row = text.color_matrix(F.expr("concat(id, '  ', -u, ' 7000')"))
    return ev(spark, sf_dir).select("id", F.transform(row, lambda r: r["num"].cast("double") / r["den"]).alias("m"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'sNEF-uncompressed' ELSE (12 + event_id % 2 * 2) || CASE WHEN event_id % 3 = 0 THEN 'bit-compressed' ELSE 'bit-uncompressed' END END AS mode FROM events")
def fn23_nef_mode(spark, sf_dir):
    return ev(spark, sf_dir).select("id", text.nef_mode(F.expr("12 + id % 2 * 2"), F.expr("id % 3 = 0"), F.expr("id % 5 = 0")).alias("mode"))


@query("SELECT event_id AS id, CASE WHEN c < 0 THEN -greatest(0, least(32767, CAST(floor(m) AS BIGINT))) ELSE greatest(0, least(32767, CAST(floor(m) AS BIGINT))) END AS v FROM (SELECT event_id, c, abs(c)::DOUBLE + 768.0::DOUBLE * abs(c)::DOUBLE * abs(c)::DOUBLE * abs(c)::DOUBLE / 16581375.0::DOUBLE AS m FROM (SELECT event_id, event_id % 511 - 255 AS c FROM events))")
def fn24_decompanding(spark, sf_dir):
    return ev(spark, sf_dir).select("id", curves.decompanded(F.expr("id % 511 - 255")).cast("long").alias("v"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def fn26_md5(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id, lower(hex(encode(left(text, 3)))) || CASE WHEN strlen(left(text, 3)) < 8 THEN repeat('00', 8 - strlen(left(text, 3))) ELSE '' END AS padded FROM documents")
def fn28_zero_filled_load(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lower(F.hex(B.padded(F.encode(F.left("text", F.lit(3)), "UTF-8"), 8))).alias("padded"))


@query("SELECT event_id AS id, CASE WHEN r = 65535 THEN coalesce(rei, r) ELSE r END AS iso FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 65535 ELSE event_id END AS r, CASE WHEN event_id % 8 = 0 THEN NULL ELSE user_id END AS rei FROM events)")
def fn30_sensitivity(spark, sf_dir):
    return ev(spark, sf_dir).select("id", text.iso(F.expr("IF(id % 4 = 0, 65535L, id)"), F.expr("IF(id % 8 = 0, NULL, u)")).alias("iso"))


@query(f"SELECT event_id AS id, [v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255] AS parts, v AS whole FROM (SELECT event_id, {E} AS v FROM events)")
def fn31_parts_of_numbers(spark, sf_dir):
    t = ev(spark, sf_dir).select("id", B.split_number(F.col("v"), 4, 8).alias("parts"))
    return t.select("id", "parts", B.joined_number(F.col("parts"), 8).alias("whole"))


@query("SELECT event_id AS id, event_id || 'x' || user_id || '-' || event_type AS mode FROM events")
def fn33_extended_mode(spark, sf_dir):
    return ev(spark, sf_dir).select("id", text.extended_mode(F.col("id"), F.col("u"), F.col("s")).alias("mode"))


@query(f"SELECT event_id AS id, {E} >> 2 AS black, ({E} + 4095) >> 2 AS white, CAST(0 AS BIGINT) AS black_up, ({E} + 4095) << 2 AS white_up FROM events")
def fn34_levels_by_precision(spark, sf_dir):
    from ..operators.variants import shifted_levels

    b, w = F.col("v"), F.col("v") + 4095
    down, up = shifted_levels(b, w, down=2), shifted_levels(b, w, up=2)
    return ev(spark, sf_dir).select("id", down["black"].alias("black"), down["white"].alias("white"), up["black"].alias("black_up"), up["white"].alias("white_up"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' ' || source END AS make FROM documents")
def src13_xmp_tag(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    xmp = F.expr("concat('<x><tiff:Make>', lang, ' ', source, IF(doc_id % 3 = 0, '</tiff:Make>', '</tiff:Mak>'), '</x>')")
    return d.select("doc_id", text.between_tags(xmp, "Make").alias("make"))


@query("SELECT range AS i, CASE WHEN range <= 1000 THEN range WHEN range <= 2000 THEN 1000 + (range - 1000) * 2 WHEN range <= 3000 THEN 3000 + (range - 2000) * 4 WHEN range <= 3500 THEN 7000 + (range - 3000) * 8 WHEN range <= 4095 THEN 11000 + (range - 3500) * 16 ELSE range END AS v FROM range(0, 16385)")
def pix29_knee_curve(spark, sf_dir):
    t = curves.knee_table([4000, 8000, 12000, 14000]).tolist()
    return spark.range(0, 0x4001).select(F.col("id").alias("i"), F.get(table_column(t), F.col("id").cast("int")).alias("v"))
