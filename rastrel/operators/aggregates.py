"""Summaries of images: sums, black levels from masked areas, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import cell


def sum_and_mean(df: DataFrame, width: int, height: int, key: str = "image_id") -> DataFrame:
    """Sums of samples and of bytes; the means divide by the number of places, also where a place has several samples."""
    low, high = F.col("v").bitwiseAND(F.lit(255)), F.shiftright(F.col("v"), 8)
    out = df.groupBy(key).agg(F.sum("v").alias("total"), F.sum(low + high).alias("byte_total"))
    return out.withColumns({"mean": F.col("total").cast("double") / (width * height), "byte_mean": F.col("byte_total").cast("double") / (2 * width * height)})


def masked_samples(df: DataFrame, areas: list[tuple[int, int, bool]], off_x: int, off_y: int, width: int, height: int, key: str = "image_id") -> DataFrame:
    """(key, cell, v, n): what masked areas (offset, size, vertical) of the full frame count. Sizes are cut to even numbers.

    As the method has it, a row of a horizontal area counts its sample at the crop's left edge once for each column of
    the crop, and a vertical area counts the sample of its first column for each of its columns.
    """
    parts = []
    for offset, size, vertical in areas:
        size -= size & 1
        if vertical:
            own = df.filter((F.col("x") == offset) & (F.col("y") >= off_y) & (F.col("y") < off_y + height))
            first, n = offset, size
        else:
            own = df.filter((F.col("x") == off_x) & (F.col("y") >= offset) & (F.col("y") < offset + size))
            first, n = off_x, width
        for odd in (0, 1):
            count = len([x for x in range(first, first + n) if x % 2 == odd])
            parts.append(own.select(key, (F.col("y").bitwiseAND(F.lit(1)) * 2 + odd).cast("int").alias("cell"), "v", F.lit(count).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "cell", "v").agg(F.sum("n").alias("n"))


def black_median(df: DataFrame, areas: list[tuple[int, int, bool]], off_x: int, off_y: int, width: int, height: int, is_cfa: bool = True, key: str = "image_id") -> DataFrame:
    """Black level of each cell: the least value of which more than an eighth of all counted places are at or below; 16-bit counters wrap, 65535 ends the walk.

    Without a filter pattern all cells get their rounded mean.
    """
    total = sum((s - (s & 1)) * (height if v else width) for _, s, v in areas)
    counts = masked_samples(df, areas, off_x, off_y, width, height, key).withColumn("n", F.pmod("n", F.lit(65536)))
    upto = F.sum("n").over(Window.partitionBy(key, "cell").orderBy("v"))
    level = F.coalesce(F.min(F.when(F.col("upto") > total // 8, F.col("v"))), F.lit(65535))
    out = counts.withColumn("upto", upto).groupBy(key, "cell").agg(level.alias("black"))
    if is_cfa:
        return out
    return out.withColumn("black", F.shiftright(F.sum("black").over(Window.partitionBy(key)) + 2, 2))


def black_mean(df: DataFrame, areas: list[tuple[int, int, bool]], off_x: int, off_y: int, width: int, height: int, key: str = "image_id") -> DataFrame:
    """Mean of each cell over all samples of the masked areas, a quarter of which it gets, at the scale of 16 bits."""
    total = sum((s - (s & 1)) * (height if v else width) for _, s, v in areas)
    hit: Column = F.lit(0)
    for offset, size, vertical in areas:
        size -= size & 1
        x, y = F.col("x"), F.col("y")
        inside = (x >= offset) & (x < offset + size) & (y >= off_y) & (y < off_y + height) if vertical else (y >= offset) & (y < offset + size) & (x >= off_x) & (x < off_x + width)
        hit = hit + inside.cast("int")  # areas that overlap count twice
    return df.withColumn("_hit", hit).filter("_hit > 0").groupBy(key, cell(F.col("x"), F.col("y")).alias("cell")).agg((F.sum(F.col("v").cast("double") * F.col("_hit")) * 65535 / (total / 4)).alias("black"))


def histogram(df: DataFrame, key: str = "image_id") -> DataFrame:
    return df.groupBy(key, cell(F.col("x"), F.col("y")).alias("cell"), "v").agg(F.count("*").alias("n"))


def digest(df: DataFrame, key: str = "image_id") -> DataFrame:
    """md5 of the md5 digests of all rows, each of its samples as little-endian 16-bit numbers, in row order."""
    le = F.lower(F.lpad(F.hex(F.shiftright(F.shiftleft(F.col("v").bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright("v", 8)), 0)), 4, "0"))
    rows = df.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.struct("x", le.alias("h")))).alias("r"))  # one row of an image
    rows = rows.select(key, "y", F.md5(F.unhex(F.array_join(F.transform("r", lambda s: s["h"]), ""))).alias("d"))
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "d"))).alias("r"))  # 16 bytes a row
    return per.select(key, F.md5(F.unhex(F.array_join(F.transform("r", lambda s: s["d"]), ""))).alias("digest"))


def black_deltas(v: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """What each parity adds to its black levels: twice the mean over all, of its half of a line."""
    n = F.count("*").over(Window.partitionBy(key))
    return v.withColumn("_n", n).groupBy(key, F.pmod(F.col(at), F.lit(2)).alias("parity")).agg((F.sum(value) / F.first("_n") * 2).alias("delta"))


def runs(results: DataFrame) -> DataFrame:
    """Decoded files, their total time, the failed ones and the first message."""
    return results.agg(F.count("*").alias("files"), F.sum("ms").alias("ms"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first_error"))


def throughput(runs: DataFrame, *keys: str) -> DataFrame:
    """Counters of a benchmark: processor and wall time, their ratio, samples and files a second."""
    t = runs.groupBy(*keys).agg(F.sum("cpu").alias("cpu"), F.sum("wall").alias("wall"), F.sum("samples").alias("samples"), F.count("*").alias("files"))
    return t.withColumns({"busy": F.col("cpu") / F.col("wall"), "samples_per_s": F.col("samples") / F.col("wall"), "samples_per_cpu_s": F.col("samples") / F.col("cpu"), "files_per_s": F.col("files") / F.col("wall")})
