"""What the corpus operators share: reading tables, shared storage, and splitting an id range evenly."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder and all runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: With it an SQL execution's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[Column] = []) -> DataFrame:  # noqa: B006
    """(doc_id, text) of a table, and `more`; a null text counts as empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no recomputation, and lineage and shuffle files end here."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what materialize() wrote for df; only for tables that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Fan-out of one level of range_bucket's search.
FAN = 64


def even_splits(df: DataFrame, key: str, rows_per_bucket: int = 256, most: int = FAN**2) -> list[int]:
    """Ascending key values that cut df into ranges of about rows_per_bucket rows (at most `most` ranges); the first is the least key.

    One pass over the key column alone; what reaches the driver is bounded by `most`.
    """
    n = df.count()
    if not n:
        return []
    parts = max(1, min(most, n // rows_per_bucket))
    quantiles = [i / parts for i in range(parts)]
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, quantiles, max(10_000, 10 * parts)).alias("q")).first()
    return sorted({x for x in [row.lo, *(row.q or [])] if x is not None})


def long_array(values: list[int]) -> Column:
    """A constant array; one constant to parse, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_bucket(key: Column, splits: list[int]) -> Column:
    """Number of the range of even_splits() that holds key (0 for what lies before, and for null), found by a two-level search inside the row."""
    if len(splits) < 2:
        return F.lit(0)
    cell = F.greatest(F.size(F.filter(long_array(splits[::FAN]), lambda s: s <= key)) - 1, F.lit(0))
    within = F.size(F.filter(F.slice(long_array(splits), cell * FAN + 1, FAN), lambda s: s <= key)) - 1
    return F.greatest(cell * FAN + within, F.lit(0)).cast("int")


def range_start(bucket: Column, splits: list[int]) -> Column:
    """The least key of a range of range_bucket()."""
    return F.get(long_array(splits), bucket) if splits else F.lit(None).cast("long")
