"""Checksum manifests: a line has 40 hex digits, two characters, and a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 40


def parsed(lines: DataFrame, root: str) -> DataFrame:
    """lines (value) with sha1, name, full_name; and `error` for lines too short to have a name."""
    ok = F.length("value") > DIGITS + 2
    name = F.substr("value", F.lit(DIGITS + 3))
    return lines.withColumns({
        "sha1": F.when(ok, F.left("value", F.lit(DIGITS))), "name": F.when(ok, name), "full_name": F.when(ok, F.concat(F.lit(root.rstrip("/") + "/"), name)), "error": F.when(~ok, "line too short"),
    })


def read_manifest(spark: SparkSession, root: str, name: str = "filelist.sha1") -> DataFrame:
    return parsed(spark.read.text(f"{root.rstrip('/')}/{name}"), root).drop("value")
