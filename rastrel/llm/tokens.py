"""Public tokenizers, applied to whole texts, a batch at a time.

For word_bpe_49k.json the normalizer, the splitter and the special strings never reach across white space, so a text's
ids are those of its chunks one after the other (`separable` checks the file for exactly that). A batch of texts is cut
at ASCII white space by numpy, Arrow numbers its distinct chunks, and only these are looked up or encoded; the
batch's ids are then gathered by number. Chunks of Latin-1 letters with trailing ASCII signs go to the library's BPE
model directly, all others through the whole library. Files of any other make are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WORD_BPE = "word_bpe_49k.json"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = re.compile(f"[{LATIN}]+")
ALL_SIGNS = string.punctuation
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The white space that texts are cut at; all of it is white space to the normalizer too.
SPACE = " \t\n\v\f\r"
IS_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
#: Bytes of text that are cut at a time, unless a single text is longer.
PART = 1 << 23


def path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def separable(spec: dict) -> bool:
    """Whether the chunks between white space are encoded independently of each other, and plain ones by letters and then signs."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = spec["model"]
    return (
        spec.get("normalizer") == NORMALIZER
        and len(pre) == 2
        and pre[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and pre[1].get("type") == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) or not re.search(f"[{LATIN}]", a["content"]) for a in spec["added_tokens"])
        and not any(spec.get(k) for k in ("truncation", "padding", "post_processor"))
        and model["type"] == "BPE" and not model["dropout"]
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """What `make` gives for a string, kept in two generations of `most` each: what is asked for again outlives what is not. Long strings are not kept."""

    LONGEST = 64

    def __init__(self, make: Callable[[str], bytes], most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def parts(texts: pa.Array, most: int = PART) -> Iterator[pa.Array]:
    """Slices of an array of strings, of about `most` bytes each."""
    texts = texts.cast(pa.large_utf8())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, the number of each chunk's in text order, where each text's chunks begin) of large strings without nulls.

    A chunk is a run without white space, or a run of it.
    """
    if not len(texts):
        return [], np.zeros(0, np.int32), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, data = int(ends[0]), texts.buffers()[2]
    if ends[-1] == low:
        return [], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = IS_SPACE[np.frombuffer(data, np.uint8)[low : int(ends[-1])]]
    begins = np.zeros(len(space) + 1, bool)
    begins[1:-1] = space[:-1] != space[1:]
    begins[ends[:-1] - low] = True
    begins[-1] = False  # of empty texts at the end
    begins = np.flatnonzero(begins) + low
    cut = np.append(begins, ends[-1])
    numbered = pa.Array.from_buffers(pa.large_utf8(), len(begins), [None, pa.py_buffer(cut), data]).dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), np.searchsorted(begins, ends)


def gathered(values: list[bytes], kind: str, which: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the texts' chunks one after the other, where each text's begin); values: of each distinct chunk as bytes of that numpy type."""
    flat = np.frombuffer(b"".join(values), kind)
    bounds = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=bounds[1:])
    bounds //= np.dtype(kind).itemsize
    taken = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat)).take(pa.array(which)).flatten().to_numpy()
    upto = np.zeros(len(which) + 1, np.int64)
    np.cumsum(np.diff(bounds)[which], out=upto[1:])
    return taken, upto[begins]


class Encoder:
    """Ids of whole texts by one tokenizer file; as bytes they are `kind` each, two of them where the vocabulary allows it."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        if file.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=file)
            self.ids = lambda text: pieces.encode(text, num_threads=1)
            self.chunked, most = False, pieces.vocab_size()
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(file)
            self.lib.no_truncation()
            self.lib.no_padding()
            self.ids = lambda text: self.lib.encode(text, add_special_tokens=False).ids
            with open(file, encoding="utf-8") as f:
                self.spec = json.load(f)
            self.chunked, most = separable(self.spec), max(self.lib.get_vocab(with_added_tokens=True).values()) + 1
            self.letters = byte_letters()
        self.code, self.kind = ("H", "<u2") if most <= 1 << 16 else ("I", "<u4")
        self.piece_ids = Memo(self.piece)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def piece(self, lowered: str) -> bytes:
        word = lowered if lowered.isascii() else "".join([self.letters[b] for b in lowered.encode()])
        return self.packed([t.id for t in self.lib.model.tokenize(word)])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk."""
        word = chunk.rstrip(ALL_SIGNS)
        if word.isalpha() and (word.isascii() or LETTERS.fullmatch(word)):
            ids = self.piece_ids[word.lower()]
            return ids if len(word) == len(chunk) else ids + self.piece_ids[chunk[len(word) :]]
        if not word:
            return self.piece_ids[chunk]
        return b"" if chunk[0] in SPACE else self.packed(self.ids(chunk))

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text's begin) of parts of an array of strings without nulls: as the library gives them, without begin, end or added special tokens."""
        for part in parts(texts):
            if self.chunked:
                distinct, which, begins = chunks_of(part)
                yield gathered(list(map(self.chunk, distinct)), self.kind, which, begins)
            else:
                own = [self.packed(self.ids(t)) for t in part.to_pylist()]
                yield gathered(own, self.kind, np.arange(len(own)), np.arange(len(own) + 1))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        return next(self.batches(pa.array([text], pa.large_utf8())))[0].astype("<u4")
