"""Queries that unpack the bytes of texts as if they were rows of samples."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import unpack as U
from ..registry import query
from . import fixtures as X

#: All rows of 48 bytes of each text, as SQL over lists of bytes b.
BYTES = """WITH d AS (SELECT doc_id, encode(text) AS raw FROM documents), p AS (SELECT doc_id, raw || unhex(repeat('00', CAST((48 - octet_length(raw) % 48) % 48 AS INTEGER))) AS data FROM d),
q AS (SELECT doc_id, hex(data) AS h, unnest(range(0, octet_length(data) // 48)) AS y FROM p), r AS (SELECT doc_id, y, substr(h, CAST(y * 96 + 1 AS BIGINT), 96) AS h FROM q),
l AS (SELECT doc_id, y, list_transform(range(0, 48), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER)) AS b FROM r)"""


PITCH = 48


def _samples(spark, sf_dir, taken):
    return U.samples(X.blobs(spark, sf_dir), taken, PITCH)


def rows(spark, sf_dir):
    return U.rows_of(X.blobs(spark, sf_dir), "data", PITCH).filter("error IS NULL").select("doc_id", "y", "row")


def _unpack_sql(n, bits, order):
    w = {"lsb": 1, "msb": 1, "msb16": 2, "msb32": 4}[order]
    at = lambda i: f"coalesce(b[CAST(({i}) // {w} * {w} + {w - 1} - ({i}) % {w} AS BIGINT) + 1], 0)"
    k = f"(k * {bits} // 8)"
    if order == "lsb":
        v = f"(({at(k)} + {at(k + ' + 1')} * 256 + {at(k + ' + 2')} * 65536 + CAST({at(k + ' + 3')} AS BIGINT) * 16777216) >> (k * {bits} % 8)) & {(1 << bits) - 1}"
    else:
        v = f"((CAST({at(k)} AS BIGINT) * 16777216 + {at(k + ' + 1')} * 65536 + {at(k + ' + 2')} * 256 + {at(k + ' + 3')}) >> ({32 - bits} - k * {bits} % 8)) & {(1 << bits) - 1}"
    return f"{BYTES} SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(k AS INTEGER) AS x, CAST({v} AS BIGINT) AS v FROM l, (SELECT unnest(range(0, {n})) AS k)"


def _unpack(n, bits, order):
    def run(spark, sf_dir):
        return _samples(spark, sf_dir, U.packed(n, bits, order).taken)

    run.__name__ = f"cdc01_unpack_{bits}_bits_{order}"
    return query(_unpack_sql(n, bits, order))(run)


for _n, _bits, _order in ((32, 12, "msb"), (32, 12, "lsb"), (27, 14, "msb32"), (24, 16, "msb16"), (38, 10, "lsb")):
    _unpack(_n, _bits, _order)


@query(f"{BYTES} SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(b[x + 1] * b[x + 1] AS BIGINT) AS v FROM l, (SELECT unnest(range(0, 48)) AS x)")
def cdc03_bytes_by_table(spark, sf_dir):
    squares = np.arange(256, dtype=np.int64) ** 2
    return _samples(spark, sf_dir, lambda b: squares[b])


@query(f"""{BYTES}, s AS (SELECT *, x // 2 * 3 + x // 10 AS o FROM l, (SELECT unnest(range(0, 30)) AS x))
SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN x % 2 = 0 THEN b[o + 1] * 16 + (b[o + 2] >> 4) ELSE (b[o + 2] & 15) * 256 + b[o + 3] END AS BIGINT) AS v FROM s""")
def cdc04_control_bytes(spark, sf_dir):
    return _samples(spark, sf_dir, U.with_control(30).taken)


@query(f"{BYTES} SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((b[x * 2 + 2] * 256 + b[x * 2 + 1]) >> 4 AS BIGINT) AS v FROM l, (SELECT unnest(range(0, 24)) AS x)")
def cdc05_left_aligned(spark, sf_dir):
    return _samples(spark, sf_dir, U.left_aligned(24).taken)


def _packets_sql(bits):
    per = 128 // bits
    b = f"(k // {per} * 16 + k % {per} * {bits} // 8)"
    return f"{BYTES} SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(k AS INTEGER) AS x, CAST(((coalesce(b[{b} + 1], 0) + coalesce(b[{b} + 2], 0) * 256 + coalesce(b[{b} + 3], 0) * 65536) >> (k % {per} * {bits} % 8)) & {(1 << bits) - 1} AS BIGINT) AS v FROM l, (SELECT unnest(range(0, {3 * per})) AS k)"


@query(_packets_sql(14))
def cdc15_packets_of_nine(spark, sf_dir):
    return _samples(spark, sf_dir, U.packets(27, 14).taken)


@query(_packets_sql(12))
def cdc13_packets_of_ten(spark, sf_dir):
    return _samples(spark, sf_dir, U.packets(30, 12).taken)


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents)
SELECT doc_id, lower(array_to_string(list_transform(range(0, (strlen(h) + 79) // 80), lambda k: substr(h, CAST(k * 80 + 55 AS BIGINT), 26) || substr(h, CAST(k * 80 + 1 AS BIGINT), 54)), '')) AS turned FROM d""")
def cdc13_swapped_blocks(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS raw")
    return d.select("doc_id", F.lower(F.hex(U.halves_swapped("raw", 40, 13))).alias("turned"))


def _bits_sql(at, n):
    b = f"(p * 16 + ({at}) // 8)"
    return f"(((coalesce(b[{b} + 1], 0) + coalesce(b[{b} + 2], 0) * 256 + coalesce(b[{b} + 3], 0) * 65536) >> (({at}) % 8)) & {(1 << n) - 1})"


@query(f"""{BYTES}, h AS (SELECT doc_id, y, b, p, {_bits_sql('0', 11)} AS hi, {_bits_sql('11', 11)} AS lo, {_bits_sql('22', 4)} AS ihi, {_bits_sql('26', 4)} AS ilo FROM l, (SELECT unnest([0, 1, 2]) AS p)),
s AS (SELECT *, (128 <= hi - lo)::INT + (256 <= hi - lo)::INT + (512 <= hi - lo)::INT + (1024 <= hi - lo)::INT AS sh, k - (ihi < k)::INT - (ilo < k AND ilo <> ihi)::INT AS j FROM h, (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS k))
SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(p * 16 + k AS INTEGER) AS x, CAST(2 * CASE WHEN k = ihi THEN hi WHEN k = ilo THEN lo ELSE least(2047, ({_bits_sql('30 + j * 7', 7)} << sh) + lo) END AS BIGINT) AS v FROM s""")
def cdc20_extremes_and_deltas(spark, sf_dir):
    return _samples(spark, sf_dir, U.extremes_and_deltas)


@query(f"WITH {X.plane_sql()} SELECT image_id, x, CASE WHEN y < 10 THEN y * 2 ELSE (y - 10) * 2 + 1 END AS y, v FROM plane")
def cdc28_interleaved_rows(spark, sf_dir):
    return X.plane_u16(spark, sf_dir).withColumn("y", U.interleaved(F.col("y"), 20)).select("image_id", "x", "y", "v")


@query(f"{BYTES} SELECT doc_id, CAST(y AS INTEGER) AS y, CAST(list_sum(b) AS BIGINT) AS total, CAST(b[1] * 256 + b[2] AS BIGINT) AS first FROM l")
def bit01_bytes_of_rows(spark, sf_dir):
    own = rows(spark, sf_dir).select("doc_id", "y", U.bytes_of("row").alias("bytes"))
    return own.select("doc_id", "y", F.aggregate("bytes", F.lit(0).cast("long"), lambda s, b: s + b).alias("total"), (F.get("bytes", F.lit(0)) * 256 + F.get("bytes", F.lit(1))).cast("long").alias("first"))
