"""Language identification, word first: a known word adds its log frequency by language, an unknown one backs off to shorter and shorter character n-grams.

The model is fitted on a bounded sample: the `sample` rows of each language whose id hashes least, each by its whole
text; of their words the `most_words` most frequent of each language are known, and n-gram counts come from the same
words, the `most_grams` most frequent of each language. So every language has the same room, and what scoring broadcasts
grows with the number of languages alone: a word or n-gram names only the languages that have it.

A word is a run of letters (Unicode category L), and of marks (M) behind a letter.

Defined results: `und` with score 0 for a null text, one without letters, or where no language could be learned; rows
with null lang or null id teach nothing; ties go to the language first in the alphabet; repeated rows are predicted
alike; an empty table gives an empty result; columns other than id, text and lang are not read.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: Values of a hash of ids, for sampling.
HASHES = 1 << 40

#: Letters, as far as `re` knows them: digits of other kinds are among them, and marks are not.
ROUGH = re.compile(r"[^\W\d_]+")


@cache
def uncertain() -> frozenset[str]:
    """All code points that ROUGH takes for letters and that are none, and all marks."""
    kinds = ((chr(i), unicodedata.category(chr(i))[0]) for i in range(128, sys.maxunicode + 1))
    return frozenset(c for c, kind in kinds if kind == "M" or kind != "L" and ROUGH.match(c))


@cache
def exact():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    return ROUGH.findall(text) if text.isascii() or uncertain().isdisjoint(text) else exact().findall(text)


@dataclass(frozen=True)
class Params:
    """sample: rows a language learns from; longest: of the n-grams; backoff: log penalty for each letter an n-gram is shorter; weight: of one word in the final score; most_seen: numbers in a worker's table of word vectors."""

    sample: int = 1000
    most_words: int = 30_000
    most_grams: int = 200_000
    most_seen: int = 20_000_000
    longest: int = 4
    backoff: float = math.log(0.4)
    weight: float = 1.0
    floor: float = 0.01


class Table:
    """Log shares by language of each key: those of the languages that have it, and one for all others. Only differences between languages matter.

    Row k has the languages langs[starts[k] : starts[k + 1]] and their logs, `rest` is that of the others. While there are
    few languages the same rows are kept in full, which is faster to add up.
    """

    FULL = 1 << 25

    def __init__(self, rows: list[tuple[str, int, float]], n_langs: int, floor: float):
        self.n_langs = n_langs
        self.at: dict[str, int] = {}
        for key, *_ in rows:
            self.at.setdefault(key, len(self.at))
        key = np.fromiter((self.at[r[0]] for r in rows), np.int64, len(rows))
        lang = np.fromiter((r[1] for r in rows), np.int64, len(rows))
        n = np.fromiter((r[2] for r in rows), np.float64, len(rows))
        cells, which = np.unique(key * n_langs + lang, return_inverse=True)
        counts, key, lang = np.bincount(which, n, len(cells)), cells // max(1, n_langs), cells % max(1, n_langs)
        rate = counts / np.maximum(np.bincount(lang, counts, n_langs), 1)[lang]
        total = np.bincount(key, rate, len(self.at))
        rest = floor * total / max(1, n_langs)
        whole = total + rest * n_langs  # of (rate + rest) over all languages
        self.starts, self.langs = np.searchsorted(key, np.arange(len(self.at) + 1)), lang.astype(np.int32)
        self.logs, self.rest = np.log((rate + rest[key]) / whole[key]).astype(np.float32), np.log(rest / np.where(whole, whole, 1)).astype(np.float32) if len(rows) else np.zeros(0, np.float32)
        self.full = None
        if len(self.at) * n_langs <= self.FULL:
            self.full = np.repeat(self.rest[:, None], n_langs, axis=1)
            self.full[key, lang] = self.logs

    def total(self, rows: list[int]) -> np.ndarray:
        """The sum of these rows, by language."""
        if self.full is not None:
            return self.full[rows].sum(axis=0, dtype=np.float64)
        out = np.full(self.n_langs, self.rest[rows].sum(dtype=np.float64))
        for k in rows:
            own = slice(self.starts[k], self.starts[k + 1])
            out[self.langs[own]] += self.logs[own] - self.rest[k]
        return out


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table
    params: Params = Params()

    def unseen(self, word: str) -> np.ndarray:
        """Log score by language of a word that is not known: at each place the longest known n-gram that ends there, shorter ones at a penalty."""
        longest, w, at, found, short = self.params.longest, f" {word} ", self.grams.at, [], 0
        for end in range(2, len(w) + 1):
            for n in range(min(longest, end), 0, -1):
                if (k := at.get(w[end - n : end])) is not None:
                    found.append(k)
                    short += longest - n
                    break
        return (self.grams.total(found) + short * self.params.backoff) / max(1, len(word))

    def vector(self, word: str) -> np.ndarray:
        known = self.words.at.get(word)
        return self.unseen(word) if known is None else self.words.total([known])


def grams_of(word: str, longest: int) -> Iterator[str]:
    w = f" {word} "
    for n in range(1, longest + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


def build(rows: list[tuple[str, str, int]], params: Params = Params()) -> Model:
    """A model from (lang, word, count)."""
    langs = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    grams: Counter[tuple[str, int]] = Counter()
    for lang, word, n in rows:
        k = at[lang]
        for g in grams_of(word, params.longest):
            grams[g, k] += n
    table = lambda counts: Table(counts, len(langs), params.floor)
    by_lang: defaultdict[int, list[tuple[str, int, float]]] = defaultdict(list)
    for (g, k), n in grams.items():
        by_lang[k].append((g, k, n))
    kept = [x for own in by_lang.values() for x in sorted(own, key=lambda x: (-x[2], x[0]))[: params.most_grams]]
    return Model(langs, table([(w, at[x], n) for x, w, n in rows]), table(kept), params)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Word counts of the sample, by language; sampling ranks ids only, so no task holds a language's texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    # of each language a share of the hash range that holds the sample and a margin; only that is ranked
    wanted = params.sample + 8 * math.isqrt(params.sample)
    cuts = [(r.lang, min(1.0, wanted / r["count"]) * HASHES) for r in sizes]
    shares = docs.sparkSession.createDataFrame(cuts, "lang string, cut double")
    some = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < F.col("cut"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)), "doc_id")
    ids = some.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.sample).select("doc_id", "lang")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = read.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
        if counts:
            (langs, words), n = zip(*counts, strict=True), list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counts = chosen.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    known = counts.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= params.most_words).select("lang", "word", "n")
    return build([tuple(r) for r in known.collect()], params)


class Seen(dict):
    """Row number of each word's vector in a growing table, which starts anew when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.most = min(300_000, max(1024, model.params.most_seen // max(1, len(model.langs))))
        self.model = model
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.model.vector(word)
        self[word] = k
        return k


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = Seen(m)
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                if not words or not m.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                if len(seen) > seen.most:
                    seen = Seen(m)
                rows = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                total = seen.table[rows].sum(axis=0, dtype=np.float64) * m.params.weight
                best = int(total.argmax())
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, by a model of the rows that are not held out."""
    p = predict(docs, fit(docs, params))
    return p.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
