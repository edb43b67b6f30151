"""A folder of container files as a stream of tag entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.containers import entries

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder, with a number for each path."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return stream.withColumn("file_id", F.xxhash64("path"))


def arriving_entries(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return entries(arriving_files(spark, folder, pattern))
