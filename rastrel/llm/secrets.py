"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only at the hits, checksums confirm what carries one.

Runs of hexadecimal digits have no keyword; they are anchored at sampled places, of which every such run has one.

Kinds `assign`, `access` and `hex` are reported on their pattern and least length alone. Kinds whose format embeds a
checksum (`github`, `npm`: CRC-32 in base 62; `xprv`: double SHA-256 in base 58) are reported only if it agrees.

Defined results: a null text is an empty one and has no spans; repeated rows give repeated rows; a null id stays null;
an empty table gives an empty result; columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_DIGITS = frozenset("0123456789abcdef")
CHECKED = {
    "github": re.compile(r"gh[oprsu]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("gho_", "ghp_", "ghr_", "ghs_", "ghu_"), "github"),
    "npm_": "npm",
    "xprv": "xprv",
}
KINDS = ("assign", "access", "hex", *CHECKED)
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def crc62(body: str) -> str:
    """CRC-32 of body as six base-62 digits."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits


def base58_ok(code: str) -> bool:
    """Whether the last four of the decoded 82 bytes are the double SHA-256 of those before."""
    n = 0
    for c in code:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def checked(kind: str, m: re.Match) -> bool:
    return base58_ok(m[0]) if kind == "xprv" else crc62(m[1]) == m[2]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int, str]]:
    """Runs of hexadecimal digits of the least length and more. Such a run has one at some place of every LEAST_HEX, so only these places are looked at."""
    found, done = [], 0
    for k, c in enumerate(text[LEAST_HEX - 1 :: LEAST_HEX], 1):
        at = k * LEAST_HEX - 1
        if c not in HEX_DIGITS or at < done:
            continue
        start, done = at, HEX.match(text, at).end()
        while start and text[start - 1] in HEX_DIGITS:
            start -= 1
        if done - start >= LEAST_HEX:
            found.append((start, done, "hex"))
    return found


def scan(text: str, a) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in text, in code points, leftmost and without overlaps within a kind."""
    folded = text if text.isascii() and text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z change, so positions stay
    hits: dict[str, list[int]] = {}
    for last, (n, kind) in a.iter(folded):
        hits.setdefault(kind, []).append(last - n + 1)
    found = []
    for kind, starts in hits.items():
        pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]
        done = 0
        for at in sorted(starts):
            if at < done or not (m := pattern.match(text, at)):
                continue
            done = m.end()
            if len(m[2]) >= LEAST_VALUE if kind == "assign" else len(m[0]) >= LEAST_ACCESS if kind == "access" else checked(kind, m):
                found.append((at, done, kind))
    found += hex_runs(text)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with the counts by kind, all spans, and a digest of the spans of the three base kinds."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            out = []
            for text in b.column(1):
                spans = scan(text.as_py(), a)
                base = [x for x in spans if x[2] not in CHECKED]
                n = [sum(k == kind for *_, k in spans) for kind in KINDS[:3]]
                out.append((*n, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"],
            )

    return texts(docs, id_col, text_col).mapInArrow(scanned, OUT)
