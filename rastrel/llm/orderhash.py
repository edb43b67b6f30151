"""Order MinHash fingerprints, as column expressions inside the row: no shuffle, no Python.

A text's k-mers are runs of `k` words (fewer words: the whole sequence), each numbered by how often it occurred before.
Their hashes fall into 64 bins; each bin keeps its two least ones, puts them into text order and hashes the pair. Bins are one permutation cut into equal parts, so a text is hashed once and not once a sketch. Signatures agree in
a bin if both k-mers and their order do, which makes the share of agreeing bins sensitive to edit distance. A k-mer is
one long, 36 bits of its hash above 28 bits of its place: arrays hold numbers and no structs, and k-mers are numbered
and chosen in sorted order.

Defined results: a null or empty text, or one of white space alone, has an empty fingerprint, alike (1) to another empty
one and unlike (0) any other; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import even_splits, range_bucket, range_start

K, SKETCH_BITS = 5, 6
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def bin_of(x: Column) -> Column:
    return F.shiftright(x, 64 - SKETCH_BITS)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with column `out`: an ascending array of longs, one for each bin that isn't empty: bin * 2**32 + hash of its pair.

    Each step is a column of its own, so that what later steps use often is computed once.
    """
    kept = [c for c in df.columns if c != out]
    w, h, g, s = (f"_{out}_{c}" for c in "whgs")
    col = F.col
    value, place = lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND(F.lit(PLACE))
    packed = lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE)))

    def step(df: DataFrame, name: str, value: Column, *drop: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c not in (*drop, name)], value.alias(name))

    df = step(df.select(*kept), w, F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), ""))
    df = step(df, h, F.transform(w, lambda x: F.xxhash64(x)), w)
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
    gram = lambda i: packed(F.xxhash64(F.slice(h, i + 1, k)), i)
    df = step(df, g, F.when(F.size(h) > 0, F.sort_array(F.transform(starts, gram))).otherwise(F.array().cast("array<bigint>")), h)
    # sorted, equal k-mers are runs in text order: the first of a run keeps its hash, the n-th gets that of hash and n
    df = step(df, s, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda j: (j == 0) | (value(F.get(g, j)) != value(F.get(g, j - 1)))))
    run = lambda a, q: F.sequence(a, F.coalesce(F.get(col(s), q + 1), F.size(g)) - 1)
    nth = lambda x, n: F.when(n == 0, x).otherwise(packed(F.xxhash64(value(x), n), place(x)))
    numbered = F.flatten(F.transform(s, lambda a, q: F.transform(run(a, q), lambda j: nth(F.get(g, j), j - a))))
    df = step(df, g, F.when((F.size(g) == 0) | (F.size(s) == F.size(g)), col(g)).otherwise(F.sort_array(numbered)), s)
    df = step(df, g, F.filter(g, lambda x, j: (j < 2) | (bin_of(x) != bin_of(F.get(col(g), j - 2)))))  # the two least of each bin

    def pair(x: Column, j: Column) -> Column:
        y = F.get(col(g), j + 1)
        mate = bin_of(y) == bin_of(x)
        ordered = F.when(~F.coalesce(mate, F.lit(False)), F.xxhash64(value(x))).when(place(x) < place(y), F.xxhash64(value(x), value(y))).otherwise(F.xxhash64(value(y), value(x)))
        first = (j == 0) | (bin_of(F.get(col(g), j - 1)) != bin_of(x))
        return F.when(first, (F.shiftleft(bin_of(x) + (1 << (SKETCH_BITS - 1)), 32)).bitwiseOR(ordered.bitwiseAND(F.lit(0xFFFFFFFF))))

    df = step(df, g, F.filter(F.transform(g, pair), lambda x: x.isNotNull()))
    return df.select(*kept, col(g).alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of the bins filled in either fingerprint that agree."""
    both = F.size(F.array_intersect(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    filled = F.size(a) + F.size(b) - both
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def text_of(fp: str) -> Column:
    """A fingerprint as text: ten hex digits for each filled bin."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def order_minhash(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the beginning of the next document's.

    The next document is the one that follows by ascending doc_id (nulls first; equal ids by text), the first after the
    last. Rows are dealt into id ranges of even size; the row that begins a range also goes, as a guest, to the range
    before, so each text moves once (a few twice) and no task orders the whole table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    splits = even_splits(docs, "doc_id")
    df = with_fingerprint(docs.withColumn("n_chars", F.length("text").cast("long")), "text", "fp")
    bucket = range_bucket(F.col("doc_id"), splits)
    last = max(len(splits) - 1, 0)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    nulls = docs.filter("doc_id IS NULL").limit(1).count() > 0
    begins = F.col("doc_id").isNull() if nulls else F.col("doc_id") == range_start(bucket, splits)
    if nulls and splits:  # nulls come first in range 0, so only they are guests of the last range
        begins = begins | ((bucket > 0) & (F.col("doc_id") == range_start(bucket, splits)))
    guest = F.struct(F.pmod(bucket - 1, F.lit(last + 1)).cast("int").alias("bucket"), F.when(bucket == 0, 2).otherwise(1).alias("guest"))
    df = df.select("doc_id", "text", "n_chars", "fp", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    # guests that wrap around sort after those of the following range; a range's own rows come first
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    df = df.select("*", "at.bucket", "at.guest").withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).filter("guest = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    df = df.select("doc_id", "n_chars", "fp", F.coalesce("next_fp", "fp").alias("next_fp"), edited.alias("edited"))
    df = with_fingerprint(df, "edited", "edited_fp")
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of("fp").alias("fingerprint"), text_of("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))

