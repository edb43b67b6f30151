"""Neighbourhood operations: repair from the nearest valid samples, stencils, and running sums.

Horizontal windows run within (image, row), vertical ones within (image, column): two exchanges for a whole image,
none of which holds more than one line. Only images that have bad samples need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32


def swept(x: Column, width: int) -> Column:
    """Whether the sweep over blocks of 32 columns gets to a column: a last block of up to half its width is left out."""
    return x < BLOCK * ((width + 15) // BLOCK)


def nearest(df: DataFrame, step: int = 2, valid: str = "ok", key: str = "image_id") -> DataFrame:
    """df with the value and distance of the nearest valid sample to the left, right, up and down (l, r, u, d): nv_*, nd_*, distance 0 if there is none.

    step 2 keeps to samples of the same place in a 2 x 2 pattern.
    """
    here = F.when(F.col(valid), F.col("v"))
    for names, line, along in ((("l", "r"), "y", "x"), (("u", "d"), "x", "y")):
        w = Window.partitionBy(key, line, F.pmod(F.col(along), F.lit(step))).orderBy(along)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        place = F.when(F.col(valid), F.col(along))
        cols = {}
        for name, take, frame in ((names[0], F.last, back), (names[1], F.first, ahead)):
            cols[f"nv_{name}"] = take(here, ignorenulls=True).over(frame)
            cols[f"nd_{name}"] = F.coalesce(F.abs(F.col(along) - take(place, ignorenulls=True).over(frame)), F.lit(0))
        df = df.withColumns(cols)
    return df


def repaired_u16(df: DataFrame, width: int, step: int = 2, key: str = "image_id") -> DataFrame:
    """Bad samples (`bad`) as means of their nearest valid neighbours, weighed by closeness, in whole numbers.

    As the method has it: a neighbour that is alone on its axis counts fully to the right or below and not at all to the
    left or above, and its axis counts in both cases; columns that the sweep leaves out stay bad.
    """
    n = nearest(df.withColumn("ok", ~F.col("bad")), step, key=key)
    total, axes = F.lit(0).cast("long"), F.lit(0)
    for a, b in ("lr", "ud"):
        span = F.col(f"nd_{a}") + F.col(f"nd_{b}")
        near = F.when(F.col(f"nd_{a}") > 0, F.floor((span - F.col(f"nd_{a}")) * 256 / span)).otherwise(0)
        here = F.coalesce(F.col(f"nv_{a}") * near, F.lit(0)) + F.coalesce(F.col(f"nv_{b}") * (256 - near), F.lit(0))
        total = total + F.when(span > 0, here).otherwise(0)
        axes = axes + F.when(span > 0, 1).otherwise(0)
    fixed = F.greatest(F.lit(0), F.least(F.lit(65535), F.call_function("shiftright", total.cast("long"), (axes + 7).cast("int"))))
    return n.withColumn("v", F.when(F.col("bad") & swept(F.col("x"), width), fixed).otherwise(F.col("v"))).select(*df.columns)


def repaired_f32(df: DataFrame, width: int, step: int = 2, key: str = "image_id") -> DataFrame:
    """As repaired_u16() for floats: negative samples count as missing; a search that passes only such ones finds no value, but the last of them still counts as its distance."""
    df = df.withColumn("_neg", F.col("v") < 0)
    n = nearest(df.withColumn("ok", ~F.col("bad") & ~F.col("_neg")), step, key=key)
    # how far a search got that found negative samples only: to the farthest one on its side that isn't bad
    for (a, b), line, along in ((("l", "r"), "y", "x"), (("u", "d"), "x", "y")):
        w = Window.partitionBy(key, line, F.pmod(F.col(along), F.lit(step))).orderBy(along)
        place = F.when(~F.col("bad"), F.col(along))
        first = F.first(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        last = F.last(place, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        for name, end in ((a, first), (b, last)):
            n = n.withColumn(f"nd_{name}", F.when(F.col(f"nv_{name}").isNull(), F.coalesce(F.abs(F.col(along) - end), F.lit(0))).otherwise(F.col(f"nd_{name}")))
    total, axes = F.lit(0.0), F.lit(0.0)
    for a, b in ("lr", "ud"):
        span = F.col(f"nd_{a}") + F.col(f"nd_{b}")
        near = F.when(F.col(f"nd_{a}") > 0, (span - F.col(f"nd_{a}")) / span.cast("double")).otherwise(0.0)
        here = F.coalesce(F.col(f"nv_{a}") * near, F.lit(0.0)) + F.coalesce(F.col(f"nv_{b}") * (1 - near), F.lit(0.0))
        total = total + F.when(span > 0, here).otherwise(0.0)
        axes = axes + F.when(span > 0, 1.0).otherwise(0.0)
    hit = F.col("bad") & swept(F.col("x"), width)
    return n.withColumn("v", F.when(hit, total / (axes + 1e-6)).otherwise(F.col("v").cast("double"))).select(*[c for c in df.columns if c != "_neg"])


def shifted(df: DataFrame, moves: dict[str, tuple[int, int]], key: str = "image_id") -> DataFrame:
    """df with samples from dx columns and dy rows away, by name; null beyond the image. Rows, then columns: two windows at most."""
    across = Window.partitionBy(key, "y").orderBy("x")
    down = Window.partitionBy(key, "x").orderBy("y")
    lead = lambda c, n, w: F.lead(c, n).over(w) if n > 0 else F.lag(c, -n).over(w) if n else F.col(c)
    df = df.withColumns({f"_{k}": lead("v", dx, across) for k, (dx, _) in moves.items()})
    return df.withColumns({k: lead(f"_{k}", dy, down) for k, (_, dy) in moves.items()}).drop(*[f"_{k}" for k in moves])


def repaired_columns(df: DataFrame, columns: list[int], green: Column, height: int, key: str = "image_id") -> DataFrame:
    """Samples of bad columns, rows 2 to height - 3: greens by three of four diagonals (without the one farthest from their mean, the first of such), others by diagonals and their row, two away."""
    near = {"a": (-1, -1), "b": (-1, 1), "c": (1, -1), "d": (1, 1)}
    wide = {"e": (-2, 2), "f": (-2, -2), "g": (2, 2), "h": (2, -2), "i": (-2, 0), "j": (2, 0)}
    n = shifted(df, near | wide, key)
    four = F.array(*near)
    total = F.aggregate(four, F.lit(0).cast("long"), lambda s, v: s + v)
    far = F.transform(four, lambda v: F.abs(v * 4 - total))
    out = F.element_at(four, F.array_position(far, F.array_max(far)).cast("int"))
    diagonals = F.col("e") + F.col("f") + F.col("g") + F.col("h")
    other = F.round(diagonals * 0.0732233 + (F.col("i") + F.col("j")) * 0.3535534).cast("long")
    fixed = F.when(green, F.floor((total - out + 1) / 3)).otherwise(other)
    hit = F.col("x").isin(columns) & (F.col("y") >= 2) & (F.col("y") < height - 2)
    return n.withColumn("v", F.when(hit, fixed).otherwise(F.col("v"))).select(*df.columns)


def running_predictor(df: DataFrame, bits: int = 16, key: str = "image_id", parity: int = 1) -> DataFrame:
    """Values of differences: each row starts from the first sample of the row before, all others from their left; wraps to `bits`.

    parity 2 keeps two predictors each way, for every other column and row.
    """
    lane_x, lane_y = F.pmod(F.col("x"), F.lit(parity)), F.pmod(F.col("y"), F.lit(parity))
    seeds = df.filter(F.col("x") < parity).withColumn("_seed", F.sum("v").over(Window.partitionBy(key, lane_x, lane_y).orderBy("y"))).select(key, "y", F.col("x").alias("_lane"), "_seed")
    rest = F.sum(F.when(F.col("x") >= parity, F.col("v")).otherwise(0)).over(Window.partitionBy(key, "y", lane_x).orderBy("x"))
    out = df.withColumns({"_rest": rest, "_lane": lane_x}).join(seeds, [key, "y", "_lane"])
    return out.withColumn("v", (F.col("_rest") + F.col("_seed")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).select(*df.columns)


#: How the high band and three low ones make the even and the odd sample, at the beginning, in the middle and at the end.
TAPS = {"first": ((1, 11, -4, 1), (-1, 5, 4, -1), 0), "middle": ((1, 1, 8, -1), (-1, -1, 8, 1), -1), "last": ((1, -1, 4, 5), (-1, 1, -4, 11), -2)}


def synthesized(df: DataFrame, line: str, along: str, n: int, descale: int = 0, key: str = "image_id") -> DataFrame:
    """Wavelet synthesis of bands (`low`, `high`) along one axis of n places: twice as many samples `v`."""
    w = Window.partitionBy(key, line).orderBy(along)
    at = lambda k: F.lead("low", k).over(w) if k > 0 else F.lag("low", -k).over(w) if k else F.col("low")
    df = df.withColumns({f"_n{k + 2}": at(k) for k in range(-2, 3)})

    def value(taps: tuple[int, ...], shift: int) -> Column:
        lows = sum((F.col(f"_n{shift + i + 2}") * t for i, t in enumerate(taps[1:])), F.lit(0).cast("long"))
        return F.shiftright(F.shiftleft(F.col("high") * taps[0] + F.shiftright(lows + 4, 3), descale), 1)

    pairs = {}
    for odd in (0, 1):
        by = {name: value(t[odd], t[2]) for name, t in TAPS.items()}
        pairs[odd] = F.when(F.col(along) == 0, by["first"]).when(F.col(along) < n - 1, by["middle"]).otherwise(by["last"])
    both = F.explode(F.array(*[F.struct((F.col(along) * 2 + odd).alias("p"), v.alias("v")) for odd, v in pairs.items()]))
    return df.select(key, line, both.alias("s")).select(key, line, F.col("s.p").alias(along), F.col("s.v").alias("v"))
