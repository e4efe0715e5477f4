"""Registration of queries with their equivalent SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import StorageError
from tablewright.session import checkpoint_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class SourceTables:
    """The Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str, *expressions: str) -> DataFrame:
        """A whole table, or SQL expressions over all its rows."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*[F.expr(e) for e in expressions]) if expressions else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` runs on the same tables in DuckDB."""

    def register(fn: Callable[[SourceTables], DataFrame]):
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, folder: fn(SourceTables(spark, folder))
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder for a query that stores tables: below the checkpoint folder, or a local one in local mode."""
    shared = checkpoint_dir(spark)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise StorageError("set spark.checkpoint.dir to a folder all executors can reach")
        local = tempfile.TemporaryDirectory(prefix="tablewright-", ignore_cleanup_errors=True)
        atexit.register(local.cleanup)
        return local.name
    return f"{shared.rstrip('/')}/catalogue/{uuid.uuid4().hex}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
