"""Token ids in sorted-string-table shards: documents by identifier in prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

A shard holds the entries of one range of keys, in order:

    blocks   entries of about BLOCK bytes: varint of that length, the entries compressed by zstd, crc32
             entry: varint shared, varint rest, varint n | rest of the key | width byte (2 or 4) and n ids, little-endian
    index    for each block: first key, offset, length, entries and ids before it in the shard
    bloom    bits of all keys, double hashing
    footer   offsets and lengths of index and bloom, numbers of entries, ids and Bloom hashes, magic

A key is the identifier as eight bytes, big-endian with the sign flipped, so byte order is number order; a null
identifier is the empty key, before all others. Shards are written once under a name of the attempt and then moved to
their final name, so a task that runs again does no harm: where the name is taken, the first attempt's file, which holds
the same, stays.

Documents that come in an order of their own (columns `order` of write_shards) keep it: shards hold ranges of that order,
and a key is a zero byte, the entry's number in its shard as eight bytes, and the identifier's own key. The Bloom filter
has the identifiers in either case; without their order an identifier is looked up by reading the shard's blocks.

A shard ends with SHARD_IDS ids or SHARD_DOCS entries, so that neither it nor the keys that its writer holds grow with the table.

Defined results: a null or empty text is the end id alone; repeated identifiers are separate entries, in the order of
their texts (or as the order of their own has them); an empty table has no shards and an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, texts
from .tokens import WORD_BPE, Encoder, path

END, BLOCK, SHARD_IDS, SHARD_DOCS, MOST_READERS = 2, 1 << 16, 1 << 25, 1 << 20, 10_000
MAGIC = b"RSSTBL02"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7
WIDTHS = {2: bytes([2]), 4: bytes([4])}
MANIFEST = "part long, roll long, path string, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def numbered(n: int, key: bytes) -> bytes:
    """The key of entry n of a shard in an order of its own."""
    return b"\0" + struct.pack(">Q", n) + key


def own_key(key: bytes) -> bytes:
    """The identifier's part of a key."""
    return key[9:] if len(key) > 8 else key


def id_of(key: bytes) -> int | None:
    own = own_key(key)
    return struct.unpack(">Q", own)[0] - (1 << 63) if own else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    from xxhash import xxh64_intdigest

    a, b = xxh64_intdigest(key, 1), xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % (1 << 64) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to a stream; keys must not fall."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.codec = pa.Codec("zstd", 1)
        self.block, self.held, self.index, self.keys = [], 0, [], []
        self.last, self.first, self.before = b"", b"", (0, 0)
        self.n_docs = self.n_ids = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes, width: int) -> None:
        """ids: of `width` bytes each."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not fall")
        if not self.block:
            self.first, self.before, self.last = key, (self.n_docs, self.n_ids), b""
        shared, n = len(os.path.commonprefix((key, self.last))), len(ids) // width
        self.block += (varint(shared) + varint(len(key) - shared) + varint(n) + key[shared:] + WIDTHS[width], ids)
        self.held += len(ids) + 1 + len(key) - shared
        self.last = key
        self.keys.append(key)
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + n
        if self.held >= BLOCK:
            self.cut()

    @property
    def full(self) -> bool:
        return self.n_ids >= SHARD_IDS or self.n_docs >= SHARD_DOCS

    def cut(self) -> None:
        if self.block:
            data = b"".join(self.block)
            packed = varint(len(data)) + self.codec.compress(data, asbytes=True)
            self.index.append((self.first, self.at, len(packed) + 4, *self.before))
            self.put(packed + struct.pack("<I", zlib.crc32(packed)))
            self.block, self.held = [], 0

    def close(self) -> None:
        self.cut()
        index_at = self.at
        self.put(b"".join(varint(len(k)) + k + b"".join(map(varint, x)) for k, *x in self.index))
        bloom_at = self.at
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for k in set(map(own_key, self.keys)):
            bloom[bloom_places(k, bits, BLOOM_HASHES)] = 1
        self.put(np.packbits(bloom).tobytes())
        self.put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.n_docs, self.n_ids, BLOOM_HASHES, MAGIC))
        self.out.close()


class Shard:
    """Reads one shard: all entries in order, or those of one identifier by Bloom filter and, where identifiers are in order, binary search."""

    def __init__(self, uri: str):
        from pyarrow import fs

        files, where = fs.FileSystem.from_uri(uri)
        self.file, self.codec = files.open_input_file(where), pa.Codec("zstd")
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.hashes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        raw, at, self.index = self.file.read_at(index_n, index_at), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at, row = raw[at : at + n], at + n, []
            for _ in range(4):
                x, at = read_varint(raw, at)
                row.append(x)
            self.index.append((key, *row))
        self.bloom = self.file.read_at(bloom_n, bloom_at)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, *_ = self.index[block]
        raw = self.file.read_at(length, offset)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        size, at = read_varint(raw, 0)
        data, at, key = self.codec.decompress(raw[at:-4], size, asbytes=True), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            width, at = data[at], at + 1
            yield key, np.frombuffer(data, f"<u{width}", n, at)
            at += n * width

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(identifier, ids before it in the shard, ids)."""
        for k in range(len(self.index)):
            start = self.index[k][4]
            for key, ids in self.entries(k):
                yield id_of(key), start, ids
                start += len(ids)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry of doc_id."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - p % 8) & 1 for p in bloom_places(key, len(self.bloom) * 8, self.hashes)):
            return []
        if self.index and len(self.index[0][0]) > 8:
            return [ids for k in range(len(self.index)) for other, ids in self.entries(k) if own_key(other) == key]
        found = []
        for k in range(max(0, bisect.bisect_left([x[0] for x in self.index], key) - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for other, ids in self.entries(k) if other == key]
        return found


def settled(files, own: str, name: str) -> None:
    """Gives an attempt's file its final name. Another attempt may have been first, and may be moving its own just now."""
    from pyarrow import fs

    if files.get_file_info(name).type == fs.FileType.NotFound:
        try:
            files.move(own, name)
            return
        except OSError:
            if files.get_file_info(name).type == fs.FileType.NotFound:
                raise
    files.delete_file(own)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, end: int = END, order: list[Column] | None = None) -> DataFrame:
    """Encodes docs and writes its shards below folder, by identifier or by the columns `order`; returns the manifest, itself written there: part and roll give their order."""
    ordered = order is not None

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, where = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, encoder, writer, rows = task.partitionId(), Encoder(path(tokenizer)), None, []
        stop, width = encoder.packed([end]), np.dtype(encoder.kind).itemsize

        def close() -> None:
            name = f"{where}/shard-{part:06d}-{len(rows):05d}.sst"
            writer.close()
            settled(files, f"{name}.{task.taskAttemptId()}", name)
            rows.append((part, len(rows), f"{folder}/{name.rpartition('/')[2]}", writer.n_docs, writer.n_ids))

        for b in batches:
            at = 0
            for ids, begins in encoder.batches(b.column(1)):
                raw, cuts = ids.tobytes(), (begins * width).tolist()
                for doc_id, x, y in zip(b.column(0).slice(at, len(cuts) - 1).to_pylist(), cuts, cuts[1:], strict=False):
                    if writer is None:
                        files.create_dir(where, recursive=True)
                        writer = Writer(files.open_output_stream(f"{where}/shard-{part:06d}-{len(rows):05d}.sst.{task.taskAttemptId()}"))
                    writer.add(numbered(writer.n_docs, key_of(doc_id)) if ordered else key_of(doc_id), raw[x:y] + stop, width)
                    if writer.full:
                        close()
                        writer = None
                at += len(cuts) - 1
        if writer is not None:
            close()
        if rows:
            p, r, u, d, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(r, pa.int64()), pa.array(u, pa.string()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["part", "roll", "path", "n_docs", "n_ids"])

    if not ordered:
        rows = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    else:
        by = [f"o{k}" for k in range(len(order))]
        rows = texts(docs, more=[c.alias(x) for c, x in zip(order, by, strict=True)]).repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    rows = rows.mapInArrow(written, MANIFEST)
    rows.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read back from the shards; start counts the ids of all entries before."""
    before = F.sum("n_ids").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Shard(uri):
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    # by number: so few rows would else be put together into one task, which would read all shards
    return shards.repartition(max(1, min(manifest.count(), MOST_READERS))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str = WORD_BPE, folder: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes docs as shards, below the shared folder if none is named, and returns what they hold."""
    return read_shards(write_shards(docs, folder or shared_dir(docs.sparkSession, "shards"), tokenizer, order=order))
