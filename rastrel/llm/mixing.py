"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order that hashing their ids shuffles, form blocks of equal size. Block k of a source of
share w (its weight over the sum of all) is released in slot floor(k / w) and due by slot ceil((k + 1) / w); in each slot
the released block with the earliest deadline runs. After any number of slots each source has then had its share of them
within less than one block. Weights are taken exactly, as fractions: the schedule repeats after as many slots as their
whole-number form sums up to, and what is made of it is that period, or the blocks at hand if these are fewer. It goes
to the shared folder in pieces, so the driver holds one piece at most.

The mix holds until a source has no block left (the first of `blocks / w`): its later slots stay empty and all other
blocks keep theirs, so no row is dropped.

Ranks within a source come from cells of hash ranges: ranks in a cell, plus the rows of the source's cells before. No
task gets a whole source. Rows travel as one struct beside the columns that the operator adds.

Defined results: a null source is a source of its own; repeated ids keep all their rows; rows without an id come first
in their source's order; sources whose weight is not given, or not above zero, have blocks but no slot (null) and come
last in the mix; columns named block, slot or place give way to the operator's own in slots() and are kept by mixed(); an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir

BLOCK, MOST_SOURCES = 64, 100_000
CELL_ROWS, MOST_CELL_BITS = 512, 20
#: Slots of the schedule that the driver holds at once.
PIECE = 1 << 19
OWN = ("block", "slot", "place")


def exact_shares(weights: dict[str, int | float | str | Fraction]) -> dict[str, int]:
    """The weights above zero as the least whole numbers of the same proportions. A float counts as the decimal number that it is written as."""
    whole = {s: Fraction(w if isinstance(w, int | Fraction) else str(w)) for s, w in weights.items()}
    whole = {s: w for s, w in whole.items() if w > 0}
    if not whole:
        return {}
    common = math.lcm(*(w.denominator for w in whole.values()))
    shares = {s: int(w * common) for s, w in whole.items()}
    least = math.gcd(*shares.values())
    return {s: n // least for s, n in shares.items()}


def schedule(shares: dict[str, int], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot): of the blocks released, the earliest deadline first.

    Without blocks one period, whose length is the sum of the shares; else as many blocks of each source as it has, and
    slots that no block is released for are passed over.
    """
    period, most = sum(shares.values()), shares if blocks is None else blocks
    waiting = [(0, s, 0) for s in sorted(shares) if most.get(s)]
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, slot
        if k + 1 < most[s]:
            heapq.heappush(waiting, ((k + 1) * period // shares[s], s, k + 1))
        slot += 1


def plan(spark: SparkSession, rows: Iterator[tuple[str, int, int]]) -> DataFrame:
    """(s, k, first): the rows of a schedule, by way of the shared folder if they are more than one piece."""
    schema = "s string, k long, first long"
    folder, pieces = shared_dir(spark, "schedule"), 0

    def piece() -> pa.Table | None:
        own = list(islice(rows, PIECE))
        if not own:
            return None
        s, k, slot = zip(*own, strict=True)
        return pa.table({"s": pa.array(s), "k": pa.array(k, pa.int64()), "first": pa.array(slot, pa.int64())})

    now = piece()
    while now is not None and (len(now) == PIECE or pieces):
        spark.createDataFrame(now).write.mode("append").parquet(folder)
        pieces, now = pieces + 1, piece()
    return spark.read.schema(schema).parquet(folder) if pieces else spark.createDataFrame(now if now is not None else [], schema)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def placed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(row, block, slot, place) for every row of docs, as a struct.

    Without weights each source's is the whole square root of its number of rows.
    """
    tie = [F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source")))] if len(docs.columns) > 2 else []
    # cells are ranges of the hash, so that a source's order runs from cell to cell; their number only bounds a cell's rows
    order = F.when(F.col("doc_id").isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key(F.col("source")).alias("s"), order.alias("h"), F.col("doc_id").alias("id"), (tie[0] if tie else F.lit(0).cast("long")).alias("tie"))
    sizes = docs.select(source_key(F.col("source")).alias("s")).groupBy("s").count().limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = {r.s: r["count"] for r in sizes}
    bits = min(MOST_CELL_BITS, max(0, math.ceil(math.log2(max(1, sum(rows.values())) / CELL_ROWS))))
    shares = exact_shares({s: math.isqrt(n) for s, n in rows.items()} if weights is None else {("" if s is None else f"={s}"): w for s, w in weights.items()})
    df = df.withColumn("cell", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    held = df.groupBy("s", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("s", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("s", "cell").orderBy("h", "id", "tie")
    rank = F.col("before") + F.col("rank")
    df = df.withColumn("rank", F.row_number().over(within) - 1).join(held, ["s", "cell"])
    df = df.select("row", "s", F.floor(rank / block).alias("block"), F.pmod(rank, F.lit(block)).cast("int").alias("place"))
    if not shares:
        return df.select("row", "block", F.lit(None).cast("long").alias("slot"), "place")
    period, blocks = sum(shares.values()), {s: -(-n // block) for s, n in rows.items() if s in shares}
    own = plan(docs.sparkSession, schedule(shares) if period <= sum(blocks.values()) else schedule(shares, blocks))
    again = {s: (n if period <= sum(blocks.values()) else blocks.get(s, 0) or 1) for s, n in shares.items()}  # blocks after which the schedule repeats, if it does
    share = docs.sparkSession.createDataFrame(list(again.items()), "s string, n long")  # one row a source
    df = df.join(F.broadcast(share), "s", "left").withColumn("k", F.pmod("block", "n")).join(own, ["s", "k"], "left")
    slot = F.floor(F.col("block") / F.col("n")) * F.lit(min(period, 1 << 62)) + F.col("first")
    return df.select("row", "block", slot.cast("long").alias("slot"), "place")


def slots(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """docs with block, slot and place (within the block); order by slot, place for the mix."""
    kept = [f"row.`{c}`" for c in docs.columns if c not in OWN]
    return placed(docs, weights, block).select(*kept, *OWN)


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of docs, its columns, in files that follow the mix."""
    df = placed(docs, weights, block).withColumn("slot", F.coalesce("slot", F.lit((1 << 63) - 1)))
    return df.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def in_file_order(docs: DataFrame) -> list[Column]:
    """What sorts docs as mixed() has dealt its rows: of a table read from files their numbers, names and rows (a scan may take the files in any order), else the place among docs' partitions."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["file_name"], at["row_index"])
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return [F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).try_cast("long"), at["file_path"], at["row_index"]]
