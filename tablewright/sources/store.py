"""The tables of one root folder: their specs, their rows and their transformed snapshots."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.errors import PlanError, StorageError
from tablewright.naming import col
from tablewright.operators.keys import METHODS
from tablewright.operators.profile import key_profile
from tablewright.sources.folder import Folder
from tablewright.sources.together import drop_pending, publish_together, undecided
from tablewright.sources.versions import BUCKETS, Draft, Version, VersionedTable
from tablewright.types import describe, shared_columns, type_name


@dataclass(frozen=True)
class TableSpec:
    """A table: its key, how files are ingested, which file names belong to it, its columns, and the number of
    buckets its rows are dealt to by key (the more, the less an upsert rewrites)."""

    name: str
    key: str
    schema: T.StructType
    method: str = "upsert"
    pattern: str | None = None
    buckets: int = BUCKETS

    def __post_init__(self):
        if self.buckets < 1:
            raise PlanError("a table has at least one bucket")
        if self.method not in METHODS:
            raise PlanError(f"unknown ingestion method {self.method!r}; use one of {METHODS}")
        if self.key.lower() not in {f.name.lower() for f in self.schema.fields}:
            raise PlanError(f"key {self.key!r} is not a column of table {self.name!r}")


@dataclass(frozen=True)
class SnapshotMeta:
    exists: bool = False
    row_count: int = 0
    columns: tuple[str, ...] = ()


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = Folder(spark, root)
        self._specs = self.root.child("specs")
        self._changes = self.root.child("changes")

    def register(self, spec: TableSpec) -> TableSpec:
        self._specs.create_json(
            f"{spec.name}.json",
            {
                "key": spec.key,
                "schema": spec.schema.jsonValue(),
                "method": spec.method,
                "pattern": spec.pattern,
                "buckets": spec.buckets,
                "registered_at": time.time_ns(),
            },
        )
        return spec

    def _record(self, name: str) -> dict:
        if not self._specs.exists(f"{name}.json"):
            raise StorageError(f"no table named {name!r}")
        return self._specs.read_json(f"{name}.json")

    def spec(self, name: str) -> TableSpec:
        """The registered spec, with the column types of the latest version."""
        raw = self._record(name)
        latest = self.rows(name).latest()
        schema = latest.schema if latest else T.StructType.fromJson(raw["schema"])
        return TableSpec(name, raw["key"], schema, raw["method"], raw["pattern"], raw.get("buckets", BUCKETS))

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._specs.names() if n.endswith(".json") and n[0] not in "_."]

    def specs(self) -> list[TableSpec]:
        """All specs in order of registration."""
        return [self.spec(n) for n in sorted(self.names(), key=lambda n: self._record(n)["registered_at"])]

    def rows(self, name: str) -> VersionedTable:
        buckets = self._record(name).get("buckets", BUCKETS) if self._specs.exists(f"{name}.json") else BUCKETS
        return VersionedTable(self.spark, self.root.url(f"tables/{name}"), buckets, lambda: undecided(self._changes, name))

    def publish(self, drafts: dict[str, Draft]) -> None:
        """Make new versions of several tables visible in one step: all of them, or none."""
        publish_together(self._changes, drafts)

    def drop_pending(self) -> list[str]:
        """Take back the changes of several tables whose writer died before publishing them."""
        return drop_pending(self._changes, {name: self.rows(name) for name in self.names()})

    def read(self, name: str) -> DataFrame:
        """All stored rows; an empty frame before the first ingest."""
        table = self.rows(name)
        latest = table.latest()
        return table.read(latest) if latest else self.spark.createDataFrame([], self.spec(name).schema)

    def retype(self, name: str, column: str, dtype: T.DataType) -> T.StructType:
        """The table's schema with one column of another type."""
        fields = self.spec(name).schema.fields
        return T.StructType(
            [T.StructField(f.name, dtype if f.name.lower() == column.lower() else f.dataType) for f in fields]
        )

    def sharing(self, name: str, column: str) -> list[str]:
        """Tables that have the column under the same name and type, this one included."""
        schema = self.spec(name).schema
        kind = next(type_name(f.dataType) for f in schema.fields if f.name.lower() == column.lower())
        by_type = shared_columns({n: self.spec(n).schema for n in self.names()}, column)
        return sorted(by_type[kind])

    def summaries(self) -> DataFrame:
        """Columns, row count and time of the last ingest (nanoseconds) of every table, newest registration
        first. They are read from the versions' notes; only a version without a count has its footers read."""
        rows = []
        for name in self.names():
            table, latest = self.rows(name), self.rows(name).latest()
            n_rows = 0 if latest is None else latest.notes.get("n_rows")
            if n_rows is None:
                n_rows = table.read(latest).count()
            columns = ", ".join(f"{column} {kind}" for column, kind in describe(self.spec(name).schema))
            ingested = None if latest is None else latest.notes.get("committed_at")
            rows.append((name, self._record(name)["registered_at"], columns, n_rows, ingested))
        schema = "table_name string, registered_at long, columns string, n_rows long, ingested_at long"
        return self.spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), schema)

    def profile(self, name: str, exact: bool = False) -> DataFrame:
        """Row count and number of distinct keys of a stored table. A version that an ingest or migration has
        published notes its rows, and its keys were checked, so it is profiled without reading a row;
        ``exact`` counts nevertheless."""
        latest = self.rows(name).latest()
        n_rows = 0 if latest is None else latest.notes.get("n_rows")
        if exact or n_rows is None:
            return key_profile(self.read(name), self.spec(name).key)
        schema = "n_rows long, distinct_keys long, has_duplicates boolean"
        return self.spark.createDataFrame([(n_rows, n_rows, False)], schema)

    def snapshots(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.root.url(f"snapshots/{name}"))

    def write_snapshot(self, name: str, df: DataFrame) -> Version:
        """Publish a run's final frame. The snapshot before it stays for those who are reading it, until
        ``vacuum``; what is older goes."""
        table = self.snapshots(name)
        before = table.latest()
        version = table.replace(df)
        if before is not None:
            table.keep_only(before)
        return version

    def drop_snapshots(self, name: str) -> None:
        """Forget the transformed output of a table."""
        self.snapshots(name).folder.delete("versions")
        self.snapshots(name).folder.delete("parts")

    def snapshot_meta(self, name: str) -> SnapshotMeta:
        """What is known of a table's transformed output; the count comes from the Parquet footers."""
        table = self.snapshots(name)
        latest = table.latest()
        if latest is None:
            return SnapshotMeta()
        return SnapshotMeta(True, table.read(latest).count(), tuple(latest.schema.names))


def alphabetical(df: DataFrame) -> DataFrame:
    """Columns in name order, the order in which stored tables list them."""
    return df.select([col(name) for name in sorted(df.columns)])
