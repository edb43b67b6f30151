"""Token counts at every prefix of a text, by dynamic programming; truncation and budgets need no re-encoding.

The table of a text holds, for each code point, by how much it changes the token count of the prefix that it ends. It is
written to the shared folder, and all answers are read from it: counts, limits, and the longest prefix that fits.

Chunks between white space are encoded independently (see tokens.py), so a text's table is those of its chunks one after
the other, and only the distinct chunks of a batch have theirs made. Inside a chunk the splitter's pieces are independent
too, and a piece's prefixes are counted by a programme over its bytes: tokens of a byte pair encoding follow each other
only if no merge across their border would have come first, so the last token of a prefix is the one entry that ends
there and is compatible with the last token of the prefix before it. Candidates come from an Aho-Corasick automaton of
the vocabulary, so a long piece takes time in proportion to its length.

What normalization changes is cut where it can't reach across; a prefix of a chunk that ends inside such a cluster is
counted as a chunk of its own, from remembered pieces. A chunk whose table doesn't end at the library's own count, which rules for
letters newer than this Python could cause, is counted prefix by prefix, as are texts under files of any other make.

Defined results: a null or empty text has 0 bytes and tokens; repeated rows are counted alike; a null id stays null; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, texts
from .tokens import ALL_SIGNS, LETTERS, SPACE, SPLIT, WORD_BPE, Encoder, Memo, chunks_of, gathered, parts, path

LIMIT = 2048
END = "</w>"
FAR = 1 << 60
#: Of a letter: no merge makes it.
SINGLE = (-1, "", "")


class Merges:
    """The merges of a byte pair encoding whose words end in END: what may follow what."""

    def __init__(self, spec: dict):
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(pairs)}
        if len(self.made) != len(pairs):
            raise ValueError("a token is made by two merges")

    def compatible(self, left: str, right: str) -> bool:
        """Whether the model leaves these two tokens side by side: the later merge at the border is undone, again and again, and none across it may come before."""
        rank, made, limit = self.rank.get, self.made.get, FAR
        l, r = made(left, SINGLE), made(right, SINGLE)
        while True:
            if rank((left, right), FAR) < limit:
                return False
            if l[0] > r[0]:
                limit, _, left = l
                l = made(left, SINGLE)
            elif r[0] >= 0:
                limit, right, _ = r
                limit += 1  # of equal merges the left one comes first
                r = made(right, SINGLE)
            else:
                return True

    def reachable(self, token: str) -> bool:
        """Whether the model makes the token of its own letters."""
        if (own := self.made.get(token)) is None:
            return True
        _, a, b = own
        inside = self.merged(a, b)
        return inside == [token]

    def merged(self, *tokens: str) -> list[str]:
        """The encoding of the letters of tokens."""
        parts: list[str] = []
        for t in tokens:
            bare = t.removesuffix(END)
            parts += bare[:-1] if len(bare) < len(t) else bare
            if len(bare) < len(t):
                parts.append(bare[-1] + END)
        while len(parts) > 1:
            rank, i = min((self.rank.get(pair, FAR), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == FAR:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Pairs(dict):
    """What a function gives for a pair; emptied when it holds too many."""

    MOST = 600_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= self.MOST:
            self.clear()
        value = self[pair] = self.make(*pair)
        return value


class PrefixCounter:
    """Exact token counts of prefixes, under one tokenizer. Tables are changes by code point, as bytes of `kind` each."""

    def __init__(self, file: str):
        self.encoder = Encoder(file)
        self.kind = np.dtype("<i4")
        if not self.encoder.chunked:
            return
        import ahocorasick
        import regex

        self.merges = Merges(self.encoder.spec)
        vocab = self.encoder.spec["model"]["vocab"]
        self.tokens = ahocorasick.Automaton()
        for t in {x.removesuffix(END) for x in vocab}:
            inner, last = t in vocab and self.merges.reachable(t), t + END in vocab and self.merges.reachable(t + END)
            if inner or last:
                self.tokens.add_word(t, (len(t), t if inner else None, t + END if last else None))
        self.tokens.make_automaton()
        # a prefix has as many tokens as one before it of at most a token's letters less, give or take these letters
        if 2 * max(map(len, vocab)) < 127:
            self.kind = np.dtype("<i1")
        self.split = regex.compile(SPLIT)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in self.encoder.spec["added_tokens"]) or r"(?!)")
        self.fit = Pairs(self.merges.compatible)
        self.piece_tables = Memo(lambda p: self.packed(self.piece_prefixes(p)))

    def packed(self, counts: list[int]) -> bytes:
        """Changes from count to count as bytes."""
        return array("b" if self.kind.itemsize == 1 else "i", map(sub, counts[1:], counts)).tobytes()

    def programme(self, letters: str, ends: list[int]) -> list[int]:
        """Counts of the words that end after as many letters as `ends` say; last_of and before hold the last token and the number of tokens of the first letters of what goes on."""
        last_of: list[str | None] = ["", *[None] * len(letters)]
        before, at_end, fit = [0] * (len(letters) + 1), [0] * (len(letters) + 1), self.fit
        for at, (n, inner, last) in self.tokens.iter(letters):
            j = at + 1 - n
            if (left := last_of[j]) is None:
                continue
            if inner and last_of[at + 1] is None and (not j or fit[left, inner]):
                last_of[at + 1], before[at + 1] = inner, before[j] + 1
            if last and not at_end[at + 1] and (not j or fit[left, last]):
                at_end[at + 1] = before[j] + 1
        return [at_end[i] for i in ends]

    def letters(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else "".join([self.encoder.letters[b] for b in text.encode()])

    def piece_prefixes(self, piece: str) -> list[int]:
        """Tokens of every prefix of one piece, the empty one first."""
        if piece.isascii():
            ends = list(range(1, len(piece) + 1))
        else:
            ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
        return [0, *self.programme(self.letters(piece), ends)]

    def normal(self, text: str) -> str:
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of every prefix of a chunk, the empty one first."""
        out, at = [0], 0
        for m in self.special.finditer(chunk):
            own = self.plain_prefixes(chunk[at : m.end() - 1])
            out += [out[at] + n for n in own[1:]] + [out[at] + own[m.start() - at] + 1]
            at = m.end()
        out += [out[at] + n for n in self.plain_prefixes(chunk[at:])[1:]]
        if out[-1] != len(self.encoder.chunk(chunk)) // np.dtype(self.encoder.kind).itemsize:
            return [len(self.encoder.ids(chunk[:i])) for i in range(len(chunk) + 1)]
        return out

    def plain_prefixes(self, text: str) -> list[int]:
        """As chunk_prefixes(), for text without special strings: clusters of code points that are normalized by themselves, then pieces."""
        if unicodedata.is_normalized("NFC", text):
            clusters = list(text)
        else:
            clusters = []
            for c in text:
                if clusters and (unicodedata.combining(c) or unicodedata.normalize("NFC", clusters[-1] + c) != unicodedata.normalize("NFC", clusters[-1]) + unicodedata.normalize("NFC", c)):
                    clusters[-1] += c
                else:
                    clusters.append(c)
        changed = [self.normal(c) for c in clusters]
        whole = "".join(changed)
        inside: dict[int, list[str]] = {}  # by the place of a cluster in the normalized text: what its own prefixes become
        ends, at = [], 0
        for c, n in zip(clusters, changed, strict=True):
            ends += [at] * (len(c) - 1) + [at + len(n)]
            if len(c) > 1:
                inside[len(ends) - len(c)] = [self.normal(c[:k]) for k in range(1, len(c))]
            at += len(n)
        counts = self.counts_at(whole)
        out = [0] + [counts[e] for e in ends]
        for first, prefixes in inside.items():
            start = ends[first]
            for k, p in enumerate(prefixes):
                out[first + k + 1] = self.counts_at(whole[:start] + p)[-1]
        return out

    def counts_at(self, text: str) -> list[int]:
        """Tokens of every prefix of normalized text."""
        out = [0]
        for m in self.split.finditer(text):
            out += [out[-1]] * (m.start() + 1 - len(out))  # of white space
            piece, base = m[0], out[-1]
            if len(piece) > 1 and piece[0] == "'" and piece[1:].isalpha():  # its prefixes are a sign and, of three letters, a word of one
                first = self.prefix_counts("'")[1]
                out.append(base + first)
                if len(piece) == 3:
                    out.append(base + first + self.prefix_counts(piece[1])[1])
                out.append(base + self.prefix_counts(piece)[-1])
            else:
                out += [base + n for n in self.prefix_counts(piece)[1:]]
        return out + [out[-1]] * (len(text) + 1 - len(out))

    def prefix_counts(self, piece: str) -> list[int]:
        return [0, *np.cumsum(np.frombuffer(self.piece_tables[piece], self.kind), dtype=np.int64).tolist()]

    def table(self, chunk: str) -> bytes:
        word = chunk.rstrip(ALL_SIGNS)
        if word.isalpha() and (word.isascii() or LETTERS.fullmatch(word)):
            own = self.piece_tables[word.lower()]
            return own if len(word) == len(chunk) else own + self.piece_tables[chunk[len(word) :]]
        if chunk[0] in SPACE:
            return bytes(len(chunk) * self.kind.itemsize)
        return self.packed(self.chunk_prefixes(chunk))

    def tables(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(changes by code point of a part of the texts, where each text's begin)."""
        for part in parts(column):
            if self.encoder.chunked:
                distinct, which, begins = chunks_of(part)
                yield gathered(list(map(self.table, distinct)), self.kind, which, begins)
            else:
                own = [self.packed([len(self.encoder.ids(t[:i])) if i else 0 for i in range(len(t) + 1)]) for t in part.to_pylist()]
                yield gathered(own, self.kind, np.arange(len(own)), np.arange(len(own) + 1))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix text[:i], i from 0 to len(text)."""
        changes = next(self.tables(pa.array([text], pa.large_utf8())))[0]
        return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


TABLE = "doc_id long, n_bytes long, width int, changes binary"


def prefix_tables(docs: DataFrame, tokenizer: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, width, changes) for every row of docs: by how much each code point changes the count of the prefix that it ends, `width` bytes each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(path(tokenizer))
        width = counter.kind.itemsize
        for b in batches:
            column, at = b.column(1).cast(pa.large_utf8()), 0
            sizes = pa.compute.binary_length(column)
            for changes, begins in counter.tables(column):
                n = len(begins) - 1
                cuts = pa.py_buffer((begins * width).astype(np.int64))
                tables = pa.Array.from_buffers(pa.large_binary(), n, [None, cuts, pa.py_buffer(changes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), sizes.slice(at, n).cast(pa.int64()), pa.array(np.full(n, width, np.int32)), tables], names=["doc_id", "n_bytes", "width", "changes"])
                at += n

    return texts(docs, id_col, text_col).mapInArrow(made, TABLE)


def answers(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) out of prefix tables alone; fit_chars: code points of the longest prefix within the limit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, fits = [], []
            for width, raw in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                counts = np.cumsum(np.frombuffer(raw.as_buffer(), f"<i{width}"), dtype=np.int64)
                tokens.append(int(counts[-1]) if len(counts) else 0)
                fits.append(len(counts) if tokens[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1] + 1) if (counts <= limit).any() else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return tables.mapInArrow(read, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def count_tokens(docs: DataFrame, tokenizer: str = WORD_BPE, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The answers for every row of docs, by way of its stored prefix tables."""
    return answers(materialize(prefix_tables(docs, tokenizer, id_col, text_col), "prefixes"), limit)
