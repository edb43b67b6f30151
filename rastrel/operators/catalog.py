"""The device catalog as relations: exact look-ups with fallbacks, support rules, and sensor levels by sensitivity.

Catalog tables are small dimensions; joins leave the choice of broadcast to the planner, which checks sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("make", "model", "mode")
SUPPORTED = ("", "supported", "no-samples")


def trimmed(c: str) -> Column:
    """Without blanks and tabs at both ends; other white space stays."""
    return F.expr(f"trim(BOTH ' \t' FROM coalesce({c}, ''))")


def first_wins(cameras: DataFrame, order: str = "doc_order") -> DataFrame:
    """One camera for each (make, model, mode), the first in file order, and `dropped`, how many came later."""
    one = F.min_by(F.struct(*[c for c in cameras.columns if c not in KEY]), order)
    rows = cameras.groupBy(*KEY).agg(one.alias("one"), (F.count("*") - 1).alias("dropped"))
    return rows.select(*KEY, "one.*", "dropped")


def look_up(files: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """files with the columns of the camera whose names are exactly theirs, trimmed; nulls where there is none."""
    own = cameras.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in cameras.columns if c not in KEY])
    on = [trimmed(k) == F.col(f"_{k}") for k in keys]
    return files.join(own, on, "left").drop(*[f"_{k}" for k in keys])


def any_mode(cameras: DataFrame) -> DataFrame:
    """For each (make, model) its first camera by mode."""
    one = F.min_by(F.struct(*[c for c in cameras.columns if c not in KEY]), "mode")
    return cameras.groupBy("make", "model").agg(F.min("mode").alias("mode"), one.alias("one")).select(*KEY, "one.*")


def by_model(cameras: DataFrame, value: str) -> DataFrame:
    """One row for each (make, model): `by_mode`, a map of `value` by mode, and `any`, that of the first camera by mode. cameras: as first_wins() gives them."""
    own = F.filter(F.collect_list(F.struct("mode", F.col(value).alias("value"))), lambda x: x["mode"].isNotNull())
    return cameras.groupBy("make", "model").agg(F.map_from_entries(own).alias("by_mode"), F.min_by(value, "mode").alias("any"))


def with_fallbacks(files: DataFrame, cameras: DataFrame, modes: tuple[str | None, ...], value: str) -> DataFrame:
    """files with `value` of the first camera found: by each mode named in turn (None: the file's own), then by no mode at all if the last is '*'. One join, however many modes."""
    own = by_model(cameras, value).select(F.col("make").alias("_make"), F.col("model").alias("_model"), F.col("by_mode").alias("_by_mode"), F.col("any").alias("_any"))
    out = files.join(own, [trimmed(k) == F.col(f"_{k}") for k in ("make", "model")], "left")
    found = [F.col("_any") if m == "*" else F.try_element_at("_by_mode", trimmed("mode") if m is None else F.lit(m)) for m in modes]
    return out.withColumn(value, F.coalesce(*found)).drop("_make", "_model", "_by_mode", "_any")


def by_file_size(sizes: DataFrame, cameras: DataFrame, size: str = "size", order: str = "doc_order") -> DataFrame:
    """sizes with the camera of that file size: only modes with "chdk", the last one added wins."""
    own = cameras.filter(F.col("mode").contains("chdk") & F.col(size).isNotNull()).groupBy(size).agg(F.max_by(F.struct("make", "model", "mode", order), order).alias("camera"))
    return sizes.join(own, size, "left")


def iso_within(iso: Column, low: Column, high: Column) -> Column:
    return ((low <= iso) & (iso <= high)) | ((iso >= low) & (high == 0))


def sensor_arrays(sensors: DataFrame) -> DataFrame:
    """For each (make, model) its number of sensors, and as an array in their order those that can be chosen: of equal ranges only the first ever is."""
    ranges = sensors.groupBy("make", "model", "iso_min", "iso_max").agg(F.min(F.struct("ord", "black", "white")).alias("s"), F.count("*").alias("n"))
    item = F.struct("s.ord", "s.black", "s.white", "iso_min", "iso_max")
    return ranges.groupBy("make", "model").agg(F.array_sort(F.collect_list(item)).alias("sensors"), F.sum("n").alias("n"))


def sensor_by_kind(kinds: DataFrame, sensors: DataFrame) -> DataFrame:
    """kinds (make, model, iso) with `sensor`: a camera's only one even if the sensitivity lies outside; else, of those within, the only one, the first that isn't the default, or the first."""
    out = kinds.join(sensor_arrays(sensors).withColumnsRenamed({"make": "_make", "model": "_model"}), (trimmed("make") == F.col("_make")) & (trimmed("model") == F.col("_model")), "left")
    within = F.filter("sensors", lambda s: iso_within(F.col("iso"), s["iso_min"], s["iso_max"]))
    out = out.withColumn("_within", within)
    plain = F.filter("_within", lambda s: (s["iso_min"] != 0) | (s["iso_max"] != 0))
    pick = F.when(F.col("n") == 1, F.get("sensors", F.lit(0))).otherwise(F.coalesce(F.get(plain, F.lit(0)), F.get("_within", F.lit(0))))
    return out.select(*kinds.columns, pick.alias("sensor"))


def choose_sensor(shots: DataFrame, sensors: DataFrame) -> DataFrame:
    """shots with `sensor`, as sensor_by_kind() says. It is chosen once for each camera and sensitivity, not for each shot."""
    names = [F.coalesce("make", F.lit("")).alias("_make"), F.coalesce("model", F.lit("")).alias("_model"), F.col("iso").alias("_iso")]
    kinds = shots.select(*names).distinct().select(F.col("_make").alias("make"), F.col("_model").alias("model"), F.col("_iso").alias("iso"))
    own = sensor_by_kind(kinds, sensors).select(*[F.col(c).alias(f"_{c}") for c in ("make", "model", "iso")], "sensor")
    on = (F.coalesce("make", F.lit("")) == F.col("_make")) & (F.coalesce("model", F.lit("")) == F.col("_model")) & F.col("iso").eqNullSafe(F.col("_iso"))
    return shots.join(own, on, "left").drop("_make", "_model", "_iso")


def support(files: DataFrame, status: str, mode: str, fail_on_unknown: bool = False) -> DataFrame:
    """files with `verdict` (true, false, or null for an error) and `no_samples`, by the camera's status."""
    known = F.col(status).isNotNull()
    unknown = F.col(status).isin("unknown", "unknown-no-samples")
    verdict = F.when(F.col(status).isin(*SUPPORTED), True).when(F.col(status) == "unsupported", None).when(F.lit(fail_on_unknown), None).otherwise(known)
    return files.withColumn("verdict", verdict).withColumn("no_samples", F.coalesce(F.col(status) == "no-samples", F.lit(False)) | ((~known | unknown) & (F.col(mode) != "dng")))


def version_gate(cameras: DataFrame, version: int, column: str = "decoder_version") -> DataFrame:
    """Cameras that code of this version can decode."""
    return cameras.filter(F.col(column) <= version)


def disable(cameras: DataFrame, make: str, model: str | None = None) -> DataFrame:
    """cameras with status `unsupported` where make, and model if given, are these."""
    hit = (F.col("make") == make) & (F.lit(model is None) | (F.col("model") == model))
    return cameras.withColumn("status", F.when(hit, "unsupported").otherwise(F.col("status")))


def hint(hints: str, name: str, kind: str, default: object) -> Column:
    """A typed hint: missing or empty ones, or such as can't be read, give the default; a boolean is true for "true" alone."""
    text = F.try_element_at(F.col(hints), F.lit(name))
    if kind == "boolean":
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text == "true")
    return F.coalesce(F.when(text != "", text.try_cast(kind)), F.lit(default).cast(kind))


def models_by_make(cameras: DataFrame) -> DataFrame:
    """For each (make, model) its distinct modes, sorted, and their number."""
    return cameras.groupBy("make", "model").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.count_distinct("mode").alias("n_modes"), F.count("*").alias("n_entries"))

