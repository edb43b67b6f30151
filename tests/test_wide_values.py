"""Queries over values that larger tables have and the given ones have not, against their SQL."""

import struct

import duckdb
import numpy as np
import pytest
from test_queries import QUERIES, SQL, rows


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Two images of events whose users, and some of whose samples, need more than 16 bits."""
    where = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    sql = """SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, 65530 + range % 900 AS user_id, 'view' AS event_type,
      CASE WHEN range % 1000 = 217 THEN 700.03 WHEN range = 1500 THEN 655.36 WHEN range = 501 THEN 90000.5 ELSE range * 7919 % 65536 / 100.0 END AS value, '' AS props FROM range(2000)"""
    con.sql(f"COPY ({sql}) TO '{where}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{where}/events.parquet'")
    return str(where), con


def same(spark, wide, name):
    got, want = QUERIES[name](spark, wide[0]).toPandas(), wide[1].sql(SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", ["src06_tiff_entries", "src06_first_width"])
def test_numbers_of_more_than_16_bits_in_tags(spark, wide, name):
    same(spark, wide, name)


@pytest.mark.parametrize("name", ["cdc06_lossless_frames", "cdc07_sliced_frames", "cdc08_paired_lengths", "cdc24_strips"])
def test_samples_of_more_than_16_bits(spark, wide, name):
    same(spark, wide, name)


@pytest.mark.parametrize("run", ["frame", "pairs", "strip"])
def test_words_of_any_size(run):
    from rastrel.operators.codecs import CodecError, in_words, of_words, predictive, prefix

    img = np.array([[0, 65535, 0, 32768, 0, -32768, 65536, 1 << 40], [-1, 65535, 32767, -(1 << 63), 70000, 5, (1 << 63) - 1, 0]])[: 1 if run == "strip" else 2]
    code = prefix.flat_code(list(range(17)))
    encode, decode, own = {
        "frame": (lambda i: predictive.encode_frame(i, 2, *code), predictive.decode_frame, {}),
        "pairs": (lambda i: predictive.encode_pairs(i, *code), predictive.decode_pairs, {"counts": code[0], "values": code[1]}),
        "strip": (lambda i: predictive.encode_strip(i[0]), predictive.decode_strip, {}),
    }[run]
    data = in_words(img, encode)
    assert (of_words(data, 8, len(img), decode, **own) == img).all()
    for hurt in (b"", data[:-1], data + bytes(4)):
        with pytest.raises((CodecError, struct.error)):
            of_words(hurt, 8, len(img), decode, **own)


@pytest.mark.parametrize("name", ["dec_end_to_end_samples", "dec_end_to_end_digests"])
def test_saturated_samples_in_files(spark, wide, name):
    same(spark, wide, name)


def test_pixmaps_of_samples_beyond_16_bits(spark, wide):
    same(spark, wide, "snk01_pixmaps_read_again")
