"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius by tiled comparison, and their components.

Two fingerprints within `radius` bits agree on all but `radius` of any k blocks of their bits, so each link shows in one
bucket of rows that agree on a choice of k - radius blocks. Inside a bucket sorted tiles are compared exactly with numpy
XOR and bit counts; tile pairs whose population counts lie further apart than the radius are skipped. A bucket beyond
TILE rows is dealt out as pairs of tiles by population count, and those too far apart are not made, so no task gets an
unbounded group, and each task returns a spanning forest of its links rather than all pairs: components stay exact.
Everything after the fingerprints moves 8-byte numbers only.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer than
three words form one shingle; repeated rows share a component; null ids keep their fingerprint and take no part in the
naming of components, null if nothing else is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, texts

SEED, SHINGLE, RADIUS = 42, 3, 3
TILE = 2048
BITS = 64
#: Rows of a tile in the comparison, and the size of a run up to which runs are compared together.
ROWS, FEW = 256, 8


def votes(digests: bytes, width: int) -> bytes:
    """The bits that over half of the digests, of `width` bytes each, have set."""
    n = len(digests) // width
    ones = np.zeros(width * 8, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(n, width)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def grams(text: bytes, shingle: int) -> list[bytes]:
    """Runs of words, repeats included; of a shorter text all words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_digest

    return int.from_bytes(votes(b"".join([xxh64_digest(g, SEED) for g in grams(text, shingle)]), 8))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py()) for x in raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")


def plan_blocks(n: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks of the block choices: more and finer blocks as n grows, so that chance buckets stay small. Any choice is exact."""
    for k in range(radius + 1, radius + 9):
        edges = [round(i * bits / k) for i in range(k + 1)]
        kept = k - radius
        if n < 64 * 2 ** (kept * bits // k) or k == radius + 8:
            blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(k)]
            return [sum(c) for c in combinations(blocks, kept)]
    raise AssertionError


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs (n, 2) within the radius that connect all that such pairs connect.

    fps: a row of 64-bit words for each fingerprint, sorted by population count. Tiles of rows meet all later rows whose
    counts are within the radius; the other tile pairs are skipped.
    """
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    root = list(range(len(fps)))
    kept = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for t in range(0, len(fps), ROWS):
        rows = fps[t : t + ROWS]
        end = int(np.searchsorted(pop, pop[t + len(rows) - 1] + radius, "right"))
        far = sum(np.bitwise_count(rows[:, None, k] ^ fps[None, t:end, k]).astype(np.uint16 if k else np.uint8, copy=False) for k in range(fps.shape[1]))
        near = far <= radius
        near &= np.arange(end - t)[None, :] > np.arange(len(rows))[:, None]
        cols = np.flatnonzero(near.any(axis=0))
        if not len(cols):
            continue
        near = near[:, cols]
        first = near.argmax(axis=0)
        pairs = [(first, cols)]  # each column to its first row, and each row once to each first row that it shares a column with
        for r in np.flatnonzero(near.any(axis=1)):
            own = np.flatnonzero(near[r])
            own = own[np.unique(first[own], return_index=True)[1]]
            pairs.append((np.full(len(own), r), cols[own]))
        for a, b in zip(np.concatenate([p[0] for p in pairs]).tolist(), np.concatenate([p[1] for p in pairs]).tolist(), strict=True):
            x, y = find(t + a), find(t + b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((t + a, t + b))
    return np.array(kept, np.int64).reshape(-1, 2)


def linked(batches: Iterator[pa.RecordBatch], radius: int, keys: list[str], words: list[str]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; rows come sorted by these and the population count of their words."""
    rest = None

    def keys_of(t: pa.Table) -> np.ndarray:
        return np.stack([t.column(c).to_numpy() for c in keys])

    def links(t: pa.Table) -> pa.RecordBatch | None:
        key, ids = keys_of(t), t.column("id").to_numpy()
        fps = np.stack([t.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
        bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(fps)]])
        sizes = np.diff(bounds)
        group, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= FEW, sizes)
        pairs = []
        for d in range(1, min(FEW, len(fps))):  # small runs together: each row against the d-th after it
            x = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if not len(x):
                break
            x = x[np.bitwise_count(fps[x] ^ fps[x + d]).sum(axis=1) <= radius]
            pairs.append(np.stack([x, x + d], axis=1))
        pairs += [forest(fps[bounds[g] : bounds[g + 1]], radius) + bounds[g] for g in np.flatnonzero(sizes > FEW)]
        found = ids[np.concatenate(pairs)] if pairs else np.empty((0, 2), np.int64)
        if not len(found):
            return None
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        key = keys_of(t)
        other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        first = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
        rest = t.slice(first).combine_chunks()
        if first and (out := links(t.slice(0, first))):
            yield out
    if rest is not None and (out := links(rest)):
        yield out


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all rows of distinct (id, fp; each fp once) whose fingerprints lie within the radius."""
    n = distinct.count()
    masks = [signed(m) for m in plan_blocks(n, radius)]
    parts = F.array(*[F.lit(m).cast("long").bitwiseAND(F.col("fp")) for m in masks])
    rows = distinct.select("id", "fp", F.bit_count("fp").alias("pop"), F.posexplode(parts).alias("mask", "part"))
    rows = dealt(rows, ["mask", "part"], F.xxhash64("fp"), radius, tile)
    keys = ["mask", "part", "i", "j"]
    rows = rows.select("id", "fp", "pop", *keys).repartition(*keys).sortWithinPartitions(*keys, "pop")
    return rows.mapInArrow(lambda it: linked(it, radius, keys, ["fp"]), "a long, b long").distinct()


def dealt(rows: DataFrame, bucket: list[str], spread: Column, radius: int, tile: int) -> DataFrame:
    """Each row (pop and others) once for each pair of tiles (i, j) of its bucket that its own is part of; buckets of at most `tile` rows are one.

    Tiles are runs of about `tile` rows in the order of population counts; rows of a count that reaches over several tiles
    are spread over these. Only tiles that have counts within the radius meet.
    """
    counts = rows.groupBy(*bucket, "pop").agg(F.count("*").alias("n"))
    large = counts.groupBy(*bucket).agg(F.sort_array(F.collect_list(F.struct(F.col("pop").cast("int").alias("pop"), "n"))).alias("pops"), F.sum("n").alias("n")).filter(F.col("n") > tile)  # as many counts as there are bits, and one
    before = lambda i: F.aggregate(F.slice("pops", F.lit(1), i), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    spans = F.transform("pops", lambda p, i: F.struct(p["pop"].alias("pop"), F.floor(before(i) / tile).cast("int").alias("first"), F.floor((before(i) + p["n"] - 1) / tile).cast("int").alias("last")))
    rows = rows.join(large.select(*bucket, spans.alias("spans")), bucket, "left")
    mine = F.get(F.filter("spans", lambda p: p["pop"] == F.col("pop")), F.lit(0))
    rows = rows.withColumn("own", F.coalesce(mine["first"] + F.pmod(spread, mine["last"] - mine["first"] + 1).cast("int"), F.lit(0)))
    near = F.filter("spans", lambda p: F.abs(p["pop"] - F.col("pop")) <= radius)
    others = F.sequence(F.array_min(F.transform(near, lambda p: p["first"])), F.array_max(F.transform(near, lambda p: p["last"])))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("spans", "own", "other")


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component): for each id of links (a, b) the least id reachable. Alternating stars: a node's larger, then smaller neighbours move to its least one.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    edges = materialize(links.filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # each node with its smaller neighbours
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.explode(F.array(F.struct("m", F.col("b").alias("x")), F.struct("m", F.col("a").alias("x")))).alias("e"))
        after = materialize(moved.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).filter("a <> b").distinct(), "links")
        discard(edges)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the least doc_id reachable over links of at most radius bits."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    named = components(near_links(distinct, radius))
    classes = materialize(distinct.join(named, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


#: Of the wide fingerprints: words of a shingle, the bits that may differ of 128, and the least Jaccard similarity.
WIDE_SHINGLE, WIDE_RADIUS, WIDE_RATIO = 5, 40, 0.8
#: Buckets that a set of shingles falls into, and least hashes that name each: sets of similarity 0.8 share none with a chance of 0.003.
BUCKETS, LEAST_HASHES = 8, 3
#: Rows of a tile of wide fingerprints, and in the verification; rows and columns of its matrices.
WIDE_TILE, VERIFIED_TILE, VERIFIED_ROWS, COLUMNS = 4096, 2048, 512, 2048
#: What tells texts of different shingle sets apart.
CLASS = ["hi", "lo", "n", "sig"]
NAMES = [f"k{i}" for i in range(BUCKETS)]
MULTIPLIERS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (BUCKETS * LEAST_HASHES + LEAST_HASHES,), np.uint64) | np.uint64(1)


def wide_digests(text: bytes, shingle: int = WIDE_SHINGLE) -> list[bytes]:
    """The set of shingles as ascending 128-bit digests."""
    from xxhash import xxh3_128_digest

    return sorted(map(xxh3_128_digest, set(grams(text, shingle))))


def bucket_names(digests: bytes) -> np.ndarray:
    """Names of a set's buckets, each made of the least of its digests under some orders of them."""
    own = np.frombuffer(digests, "<u8")[::2]
    if not len(own):
        return np.zeros(BUCKETS, np.uint64)
    orders = MULTIPLIERS[: BUCKETS * LEAST_HASHES, None]
    least = np.min([(own[None, k : k + (1 << 14)] * orders).min(axis=1) for k in range(0, len(own), 1 << 14)], axis=0)
    least ^= least >> np.uint64(29)
    return (least.reshape(BUCKETS, LEAST_HASHES) * MULTIPLIERS[BUCKETS * LEAST_HASHES :]).sum(axis=1, dtype=np.uint64)


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, hi, lo, n, sig, k0 ...): 128-bit fingerprints of the distinct shingles, their number, a hash of the whole set, and its buckets."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            fps, n, sigs, names = [], [], [], np.zeros((len(b), BUCKETS), np.uint64)
            for i, x in enumerate(b.column(1).cast(pa.binary())):
                own = wide_digests(x.as_py(), shingle)
                joined = b"".join(own)
                fps.append(votes(joined, 16))
                n.append(len(own))
                sigs.append(xxh3_64_intdigest(joined))
                names[i] = bucket_names(joined)
            both = np.frombuffer(b"".join(fps), ">i8").astype(np.int64).reshape(-1, 2)
            sig = np.array(sigs, np.uint64).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in range(BUCKETS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n, pa.int64()), pa.array(sig), *columns], names=["doc_id", *CLASS, *NAMES])

    return texts(docs).mapInArrow(hashed, "doc_id long, hi long, lo long, n long, sig long, " + ", ".join(f"{k} long" for k in NAMES))


def incidence(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of each shingle that more than one row has, ascending by column, and the number of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets])
    _, name, times = np.unique(np.frombuffer(b"".join(sets), np.int64), return_inverse=True, return_counts=True)
    common = times > 1
    kept = np.flatnonzero(common[name])
    column = (np.cumsum(common) - 1)[name[kept]]
    order = np.argsort(column, kind="stable")
    return owner[kept][order], column[order], int(common.sum())


def shared_counts(places: tuple[np.ndarray, np.ndarray, int], n: int, rows: slice) -> np.ndarray:
    """How many shingles each of some rows shares with each of all n: products of matrices, some columns at a time."""
    owner, column, columns = places
    out = np.zeros((len(range(*rows.indices(n))), n), np.float32)
    for k in range(0, columns, COLUMNS):
        low, high = np.searchsorted(column, (k, k + COLUMNS))
        has = np.zeros((n, min(COLUMNS, columns - k)), np.float32)
        has[owner[low:high], column[low:high] - k] = 1
        out += has[rows] @ has.T
    return out


def similar(fps: np.ndarray, sets: list[bytes], tiles: np.ndarray, radius: int, ratio: float) -> list[tuple[int, int]]:
    """Index pairs within the radius and of at least that Jaccard similarity that connect all that such pairs connect. Of two tiles, rows meet those of the other one only."""
    n = np.array([len(x) // 8 for x in sets])
    label, kept, places = np.arange(len(sets)), [], None
    for at in range(0, len(sets), VERIFIED_ROWS):
        own = slice(at, at + VERIFIED_ROWS)
        far = sum(np.bitwise_count(fps[own, None, k] ^ fps[None, :, k]).astype(np.uint16) for k in range(fps.shape[1]))
        near = (far <= radius) & (np.arange(len(sets))[None, :] > np.arange(len(sets))[own, None])
        if tiles[0] != tiles[-1]:
            near &= tiles[own, None] != tiles[None, :]
        if not near.any():
            continue
        places = places or incidence(sets)
        common = shared_counts(places, len(sets), own)
        near &= common >= ratio * np.maximum(n[own, None] + n[None, :] - common, 1)
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            found = np.flatnonzero(near[r])
            found = found[np.unique(label[found], return_index=True)[1]]
            found = found[label[found] != label[at + r]]
            if len(found):
                kept += [(at + r, c) for c in found.tolist()]
                label[np.isin(label, label[found])] = label[at + r]
    return kept


def verified(batches: Iterator[pa.RecordBatch], radius: int, ratio: float, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Links by similar() within each run of equal keys; rows come sorted by these and their tile."""
    rest = None

    def links(t: pa.Table) -> pa.RecordBatch:
        key, ids = np.stack([t.column(c).to_numpy() for c in keys]), t.column("id").to_numpy()
        fps = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1)
        bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(ids)]]).tolist()
        tiles = t.column("own").to_numpy()
        pairs = [(a + x, a + y) for a, b in zip(bounds, bounds[1:], strict=False) for x, y in similar(fps[a:b], t.column("shingles").slice(a, b - a).to_pylist(), tiles[a:b], radius, ratio)]
        found = ids[np.array(pairs, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        key = np.stack([t.column(c).to_numpy() for c in keys])
        other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
        first = int(other[-1]) + 1 if len(other) else 0  # the last run may go on in the next batch
        rest = t.slice(first).combine_chunks()
        if first:
            yield links(t.slice(0, first))
    if rest is not None and len(rest):
        yield links(rest)


def verified_links(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, radius: int, ratio: float, tile: int) -> DataFrame:
    """(a, b): of the links within the radius those whose sets of shingles are similar, as far as needed to connect what these connect.

    distinct: (id, hi, lo, n, sig). Candidate links only say which texts may meet: the sets of their components' members
    are compared, each with all others in tiles, so that no link hangs on the choice of the candidates' forests.
    """
    rows = distinct.join(components(candidates), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    rows = materialize(rows, "groups")
    sizes = rows.groupBy("group").count().filter("count > 1").select("group", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.select("id", *CLASS, "group").join(sizes, "group")
    rows = texts(docs).join(rows, F.col("doc_id") == F.col("id")).select("text", "id", *CLASS, "group", "tiles")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            sets, own = [], []
            for k, (x, sig) in enumerate(zip(b.column(0).cast(pa.binary()), b.column(5).to_pylist(), strict=True)):
                digests = wide_digests(x.as_py())
                if signed(xxh3_64_intdigest(b"".join(digests))) == sig:  # else another text of a repeated id
                    own.append(k)
                    sets.append(b"".join([d[:8] for d in digests]))
            kept = b.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(sets, pa.binary())], names=[*kept.schema.names[1:], "shingles"])

    rows = rows.mapInArrow(shingled, "id long, hi long, lo long, n long, sig long, `group` long, tiles int, shingles binary")
    keys = ["group", "i", "j"]
    own = F.pmod(F.xxhash64("sig"), "tiles").cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select("id", "hi", "lo", "shingles", "own", *keys).repartition(*keys).sortWithinPartitions(*keys, "own")
    return rows.mapInArrow(lambda it: verified(it, radius, ratio, keys), "a long, b long").distinct()


def near_copies(docs: DataFrame, radius: int = WIDE_RADIUS, ratio: float = WIDE_RATIO, tile: int = VERIFIED_TILE) -> DataFrame:
    """(doc_id, component_id) by sets of five-word shingles: components of links within the radius of 128-bit fingerprints and of at least `ratio` Jaccard similarity.

    At a similarity of 0.8 some 19 bits differ, give or take 4; the radius leaves five times that. A radius this wide has no blocks of bits
    that prune, so fingerprints meet in buckets named by least hashes of their sets; inside, tiles are compared as they are for
    near_duplicates(). Links within the radius are candidates, and verified on the sets.

    Defined results: a null or empty text, or one without words, has the empty set and is a copy of others like it; fewer
    than five words form one shingle; repeated rows share a component; rows without an id have no component unless a row
    with one has the same set; an empty table gives an empty result; other columns are not read.
    """
    prints = materialize(wide_fingerprints(docs), "fingerprints")
    distinct = materialize(prints.filter("doc_id IS NOT NULL").groupBy(*CLASS).agg(F.min("doc_id").alias("id"), *[F.first(k).alias(k) for k in NAMES]), "distinct")
    rows = distinct.select("id", "hi", "lo", (F.bit_count("hi") + F.bit_count("lo")).alias("pop"), F.posexplode(F.array(*NAMES)).alias("bucket", "name"))
    rows = dealt(rows, ["bucket", "name"], F.xxhash64("hi", "lo"), radius, WIDE_TILE)
    keys = ["bucket", "name", "i", "j"]
    rows = rows.select("id", "hi", "lo", "pop", *keys).repartition(*keys).sortWithinPartitions(*keys, "pop")
    links = rows.mapInArrow(lambda it: linked(it, radius, keys, ["hi", "lo"]), "a long, b long").distinct()
    named = components(verified_links(docs, distinct, links, radius, ratio, tile))
    classes = materialize(distinct.join(named, "id", "left").select(*CLASS, F.coalesce("component", "id").alias("component_id")), "classes")
    discard(distinct)
    return prints.join(classes, CLASS, "left").select("doc_id", "component_id")
