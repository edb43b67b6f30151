"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of lower-cased runs of letters and digits. A mask fixes which positions of a window count; the
others may differ. Hashes of all masked windows of the benchmark are joined with those of all windows of the documents;
a hit fixes how a document and an item lie against each other, and the overlap along that diagonal is verified: some
stretch of `span` words (the whole item, if shorter) must agree in at least `least` of its places.

The benchmark is broadcast in blocks of whole items, of about BLOCK windows each, which are counted first; each block
passes over all documents. Items are dealt to blocks by hash, so a key that many items share is spread too, and a block
beyond twice its size makes more blocks, down to single items. A hit is kept if enough words agree around the seed, before anything moves: what many
items begin with costs no shuffle. Hits carry the stretch of the document that lies against the item, so documents are
never shuffled.

An item's masks depend on its number of words; those of four words or fewer have to agree as a whole. Only the masks of
lengths that the benchmark has are looked up.

Defined results: null or empty texts and empty tables match nothing; equal
items are matched once and each is reported; repeated rows are reported once for each id; null ids are kept as such;
columns other than the ids and texts are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By words of an item, the last for all longer ones; 1: the position counts. Whatever SPAN and LEAST let differ, some mask
#: fits where all words agree: all choices of one word of 5 to 9, two of 10 to 14 and three of 15 were tried. Of 16 words
#: with three that differ 15 are such a stretch, and words beyond a document's edges count as different.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011", "11101", "10111"),
    6: ("11111", "101111", "111101", "110111", "111011"),
    7: ("110111", "1011101", "111101"),
    8: ("1110111", "10111101", "11011011"),
    9: ("10111111", "111101101", "111010111", "11111101"),
    10: ("1110111", "11011011", "111111", "1110000111", "1101001011"),
    11: ("1110111", "110100111", "1111101", "11000111001"),
    12: ("11101111", "1111010011", "11010011011", "110011111", "110110101001"),
    13: ("11110111", "1110010111", "1100101001011"),
    14: ("1110110111", "11001111011", "111101000111", "1101011010101"),
    15: ("11011111", "111100001011", "11010100111", "11100010100011", "101001001111"),
}
SPAN, LEAST = 16, 0.8
BLOCK = 1_000_000


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def hashed(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """df's kept columns and h, the hashes of the words of text."""
    df = df.select(*keep, words(text).alias("_w"))
    return df.select(*[c for c in df.columns if c != "_w"], F.transform("_w", lambda w: F.xxhash64(w)).alias("h"))


def windows(df: DataFrame, lengths: list[int], items: bool = False, masks: dict[int, tuple[str, ...]] = MASKS) -> DataFrame:
    """df with a row for each mask and place where it fits: at (0-based) and key, the hash of the words that count.

    The masks are those of the items' lengths, as in masks; items have only those of their own.
    """
    n, longest = F.size("h"), max(masks)
    used = sorted({m for k in lengths for m in masks[k]}, key=lambda m: (len(m), m))
    shortest = len(used[0])
    # no filter on what is made of h, and none inferred: it would go below the projection that makes h, and make it twice
    df = df.select("*", F.explode_outer(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))).alias("at"))

    def key(k: int, mask: str) -> Column:
        parts = [F.get("h", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        fits = F.col("at") + len(mask) <= n
        if items:
            fits &= F.least(n, F.lit(longest)).isin([x for x in lengths if mask in masks[x]])
        return F.when(fits, F.xxhash64(*parts, F.lit(k)))

    return df.select("*", F.explode(F.array(*[key(k, m) for k, m in enumerate(used)])).alias("key")).filter("key IS NOT NULL")


def dealt(seeds: DataFrame, block: int) -> int:
    """Into how many blocks items go by hash, so that none has more than about `block` windows; one item is never split."""
    n, items = seeds.agg(F.count("*"), F.count_distinct("item")).first()
    blocks = max(1, -(-n // block))
    while 1 < blocks < items and seeds.groupBy(F.pmod("item", F.lit(blocks)).alias("b")).count().agg(F.max("count")).first()[0] > 2 * block:
        blocks = min(2 * blocks, items)
    return blocks


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: dict[int, tuple[str, ...]] = MASKS, span: int = SPAN, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, best, matched, n_words): best words that agree in one stretch, all that agree along the best diagonal, words of the item."""
    items = hashed(benchmark, "text", F.col("item_id"))
    distinct = items.groupBy("h").agg(F.min("item_id").alias("class")).select("class", "h", F.xxhash64("h").alias("item"))  # equal items once
    lengths = [r.n for r in distinct.filter(F.size("h") > 0).select(F.least(F.size("h"), F.lit(max(masks))).alias("n")).distinct().collect()] or [max(masks)]  # at most one for each of masks
    seeds = windows(distinct, lengths, True, masks).select("key", "item", F.col("at").alias("item_at"), F.size("h").alias("item_n"))
    blocks = dealt(seeds, block)
    train = windows(hashed(docs, "text", F.col("doc_id").cast("long").alias("doc_id")), lengths, False, masks)
    lead = F.col("at") - F.col("item_at")  # where the item's first word lies in the document
    # what agrees within a stretch of either side of the seed
    low = F.greatest(F.col("item_at") - (span - 1), -lead, F.lit(0))
    high = F.least(F.col("item_at") + (max(map(len, reduce(lambda x, y: x + y, masks.values()))) + span - 1), F.col("item_n"), F.size("h") - lead)
    near = F.size(F.filter(F.zip_with(F.slice("item_h", low + 1, high - low), F.slice("h", lead + low + 1, high - low), lambda x, y: x == y), lambda x: x))
    begin, end = F.greatest(lead, F.lit(0)), F.least(lead + F.col("item_n"), F.size("h"))
    parts = []
    for k in range(blocks):
        mine = lambda df: df if blocks == 1 else df.filter(F.pmod("item", F.lit(blocks)) == k)  # noqa: B023, E731
        met = train.join(F.broadcast(mine(seeds)), "key").join(F.broadcast(mine(distinct).select("item", F.col("h").alias("item_h"))), "item")
        met = met.filter(near >= F.ceil(F.least(F.lit(span), F.col("item_n")) * F.lit(least)))
        parts.append(met.select("doc_id", "item", lead.alias("lead"), F.slice("h", begin + 1, end - begin).alias("stretch")))
    hits = reduce(DataFrame.unionAll, parts)
    # a seed may hit many times along one diagonal: one row each, already before the shuffle; texts of a repeated id are told apart by the stretch
    hits = hits.distinct()
    pairs = hits.join(distinct.select("item", F.col("h").alias("item_h")), "item")
    first = F.greatest(-F.col("lead"), F.lit(0))
    against = F.slice("item_h", first + 1, F.size("stretch"))
    same = F.zip_with(against, "stretch", lambda a, b: (a == b).cast("int"))
    pairs = pairs.select("doc_id", "item", F.size("item_h").alias("n_words"), same.alias("same"))
    width = F.least(F.lit(span), F.col("n_words"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - width + 1, F.lit(1))), lambda i: total(F.slice("same", i, width)))
    found = pairs.select("doc_id", "item", "n_words", F.array_max(sums).alias("best"), total(F.col("same")).alias("matched"), width.alias("width"))
    found = found.filter(F.col("best") >= F.ceil(F.col("width") * F.lit(least)))
    found = found.groupBy("doc_id", "item").agg(F.max("best").alias("best"), F.max("matched").alias("matched"), F.first("n_words").alias("n_words"))
    named = items.select("item_id", F.xxhash64("h").alias("item")).distinct()
    return found.join(named, "item").select("doc_id", "item_id", "best", "matched", "n_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that overlap no item. Rows without an id stay."""
    leaks = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
