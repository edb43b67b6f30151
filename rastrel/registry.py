"""Name -> (query, SQL): what the driver contract and the tests read."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("catalog", "tags", "geometry", "pixels", "neighbours", "aggregates", "scalars", "unpacking", "containers", "codecs", "storage")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its DuckDB SQL if there is any."""

    def registered(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return registered


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"rastrel.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_levels_by_family"](spark, sf_dir)
