"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text, each counted once: words, pairs of neighbours, and pairs with one word between, hashed into 2**bits
buckets. Per-coordinate rates and L1 leave few weights that are not zero; those are what scoring broadcasts, at most
2**bits of them. Training takes a bounded sample: of the labelled rows, the `sample` whose
id hashes least, in their natural shares; both training and scoring read whole texts.

Defined results: a null or empty text is scored by the bias alone; labels other than 0 and 1, and null labels or ids,
teach nothing; without labels of both kinds the score is the share of label 1 (0 if there are none); repeated rows are
scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, texts

BITS = 20
#: Odd multipliers that mix two word hashes into the hash of a pair and of a skip-gram.
PAIR, SKIP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of FTRL-proximal, and how often it passes over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 3
    sample: int = 10_000


class Words(dict):
    """Hash of each word met so far; emptied when it holds too many."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh32_intdigest

        if len(self) >= self.MOST:
            self.clear()
        h = xxh32_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


#: Everything in ASCII that parts words.
PARTING = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def features(text: bytes, words: Words, bits: int = BITS) -> np.ndarray:
    """Buckets of all features of text, repeats included."""
    found = text.lower().translate(PARTING).split()
    h = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
    return np.concatenate([h, h[:-1] * PAIR + h[1:], (h[:-2] + np.uint32(1)) * SKIP + h[2:]]) >> np.uint32(32 - bits)


def train(examples: Callable[[], Iterable[tuple[np.ndarray, int]]], ftrl: Ftrl = Ftrl(), bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) from (distinct buckets, label), asked for once an epoch and in the order given; buckets ascend, weights are not zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0
    for _ in range(ftrl.epochs):
        for idx, y in examples():
            zi, ni = z[idx], n[idx]
            w = np.where(np.abs(zi) <= ftrl.l1, 0.0, (np.sign(zi) * ftrl.l1 - zi) / ((ftrl.beta + np.sqrt(ni)) / ftrl.alpha + ftrl.l2))
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + bias)))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ftrl.alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
            bias_n += g * g  # the bias learns by its own rate and without penalty
            bias -= ftrl.alpha / (ftrl.beta + math.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= ftrl.l1, 0.0, (np.sign(z) * ftrl.l1 - z) / ((ftrl.beta + np.sqrt(n)) / ftrl.alpha + ftrl.l2))
    at = np.flatnonzero(w)
    return at.astype(np.uint32), w[at], bias


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def sampled(docs: DataFrame, labels: DataFrame, ftrl: Ftrl) -> DataFrame:
    """(doc_id, y, x: distinct buckets as bytes), the training sample: the labelled rows whose id hashes least. One text for each id, the least; if its rows disagree on the label, none."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL")
    own = own.filter(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).filter("y = high").select("doc_id", "y")
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ftrl.sample)  # a top-k on ids alone
    cut = texts(docs).join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words()
        for b in batches:
            raw = b.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(features(x.as_py(), own)).astype("<u4").tobytes() for x in raw], pa.binary())], names=["doc_id", "y", "x"])

    found = cut.mapInArrow(hashed, "doc_id long, y int, x binary")
    return materialize(found.groupBy("doc_id", "y").agg(F.min("x").alias("x")), "examples")


def fit(docs: DataFrame, labels: DataFrame, ftrl: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """The model. The driver trains as the examples come by, once an epoch, and holds one partition of them at a time."""
    examples = sampled(docs, labels, ftrl)
    ones, n = examples.agg(F.count_if(F.col("y") == 1), F.count("*")).first()
    if not 0 < ones < n:
        share = min(max(ones / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return np.empty(0, np.uint32), np.empty(0), math.log(share / (1 - share))
    ordered = examples.orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "y")
    model = train(lambda: ((np.frombuffer(bytes(r.x), "<u4"), r.y) for r in ordered.toLocalIterator()), ftrl)
    discard(examples)
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: the chance of label 1 by the whole text."""
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at, w, bias))  # at most 2**BITS weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float64)
        dense[at] = w
        words = Words()
        for b in batches:
            out = np.empty(len(b))
            for i, x in enumerate(b.column(1).cast(pa.binary())):
                f = features(x.as_py(), words)
                f = np.unique(f[dense[f] != 0])
                out[i] = 1 / (1 + math.exp(-max(-700.0, min(700.0, float(dense[f].sum()) + bias))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, ftrl: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, by a model of the labels that are not held out."""
    s = score(docs, fit(docs, labels, ftrl))
    return s.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
