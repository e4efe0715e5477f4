"""Ingest of files or frames into a keyed table.

The batch is written once, as Parquet next to the table, and every later pass reads that: key
checks read the key column only, every method deals its rows to the table's buckets, and a lost
executor re-reads files instead of parsing the input again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PlanError
from tablewright.naming import col, field_of
from tablewright.operators import keys as K
from tablewright.operators.casts import plain_cast
from tablewright.sources.files import (
    ORDER_COLUMNS,
    as_types,
    infer_schema,
    list_files,
    match_tables,
    name_pattern,
    narrowest_types,
    read_csv,
    read_text,
)
from tablewright.sources.store import TableSpec, TableStore
from tablewright.sources.versions import Version, VersionedTable
from tablewright.types import SchemaDiff, normalize_frame, schema_diff

_PART = "__part"


@dataclass(frozen=True)
class IngestResult:
    """What an ingest did. ``skipped`` is a frame with one key per skipped row."""

    rows_ingested: int = 0
    skipped: DataFrame | None = None
    diff: SchemaDiff | None = None
    error: str | None = None
    version: int | None = None

    @property
    def ok(self) -> bool:
        return self.error is None and self.diff is None

    @property
    def requires_confirmation(self) -> bool:
        return self.diff is not None


def register_csv(
    store: TableStore, name: str, key: str, paths: str | list[str], method: str = "upsert"
) -> TableSpec:
    """Declare a table from sample files: inferred column types, and the pattern of the first
    file's name for the files to come. No row is stored."""
    first = paths if isinstance(paths, str) else paths[0]
    schema = infer_schema(store.spark, paths)
    return store.register(TableSpec(name, key, schema, method, name_pattern(store.spark, first)))


def ingest_csv(
    store: TableStore,
    table: str,
    paths: str | list[str],
    method: str | None = None,
    confirm_drift: bool = False,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> IngestResult:
    """Ingest all files in one batch; rows keep the order of (file, row).

    The input is read once. Without a schema its fields are written as text next to the table; an aggregate
    over that finds their types, which tell drift, and the values are read from it.
    """
    order = [F.col(name) for name in ORDER_COLUMNS]
    spec = store.spec(table)
    method = (method or spec.method).lower()
    if method not in K.METHODS:
        return IngestResult(error=f"unknown ingestion method {method!r}")
    try:
        if schema is not None:
            batch = read_csv(store.spark, paths, schema, multi_line, order=True)
            return ingest_frame(store, table, batch, method, confirm_drift, order)
        batch = read_text(store.spark, paths, multi_line, order=True)
    except (PlanError, PySparkException) as cause:
        return IngestResult(error=f"cannot read {paths!r}: {cause}")
    rows = store.rows(table)
    before = rows.latest()
    try:
        landed = rows.write_part(batch)
    except Exception as cause:  # noqa: BLE001 - the input itself is bad; the table is unchanged
        return IngestResult(error=str(cause))
    text = rows.spark.read.schema(batch.schema).parquet(rows.folder.url(f"parts/{landed}"))
    found = narrowest_types(text.drop(*ORDER_COLUMNS))
    refused = _refused(schema_diff(spec.schema, found), confirm_drift)
    if refused is not None:
        rows.drop_part(landed)
        return refused
    typed = as_types(text, found)
    columns = [_registered(typed, field, schema_diff(spec.schema, found)).alias(field.name) for field in _stored_fields(spec)]
    full = typed.select(*columns, *[position.alias(f"__o{i}") for i, position in enumerate(order)])
    try:
        return _publish(rows, before, spec, landed, full, method, len(order), {})
    except Exception as cause:  # noqa: BLE001 - nothing was published
        return IngestResult(error=str(cause))


def _refused(diff: SchemaDiff, confirm_drift: bool) -> IngestResult | None:
    if diff and not confirm_drift:
        return IngestResult(diff=diff)
    if diff.removed:
        return IngestResult(error=f"columns missing from the input: {list(diff.removed)}")
    return None


def ingest_frame(
    store: TableStore,
    table: str,
    batch: DataFrame,
    method: str | None = None,
    confirm_drift: bool = False,
    order: list[Column] | None = None,
    **notes,
) -> IngestResult:
    """Ingest a frame. ``order`` decides which of several rows with one key comes first;
    without it, rows are numbered as Spark reads them."""
    spec = store.spec(table)
    method = (method or spec.method).lower()
    if method not in K.METHODS:
        return IngestResult(error=f"unknown ingestion method {method!r}")
    if order is None:
        batch = batch.select("*", F.monotonically_increasing_id().alias("__row"))
        order = [F.col("__row")]
    hidden = [name for name in batch.columns if name in ORDER_COLUMNS]
    incoming = normalize_frame(batch.drop(*hidden))

    diff = schema_diff(spec.schema, incoming.schema)
    refused = _refused(diff, confirm_drift)
    if refused is not None:
        return refused

    rows = store.rows(table)
    before = rows.latest()
    # The order is part of the written batch, whatever expression it came from.
    positions = [position.alias(f"__o{i}") for i, position in enumerate(order)]
    batch = normalize_frame(batch)
    typed = [_registered(batch, field, diff).alias(field.name) for field in _stored_fields(spec)]
    try:
        landed = rows.write_part(batch.select(*typed, *positions))
    except Exception as cause:  # noqa: BLE001 - the input itself is bad; the table is unchanged
        return IngestResult(error=str(cause))
    full = rows.spark.read.parquet(rows.folder.url(f"parts/{landed}"))
    try:
        return _publish(rows, before, spec, landed, full, method, len(positions), notes)
    except Exception as cause:  # noqa: BLE001 - nothing was published
        return IngestResult(error=str(cause))


def _stored_fields(spec: TableSpec) -> list[T.StructField]:
    """Stored tables list their columns alphabetically."""
    return sorted(spec.schema.fields, key=lambda f: f.name)


def _registered(batch: DataFrame, field: T.StructField, diff: SchemaDiff) -> Column:
    """A batch column in its registered type. A value the type cannot hold fails the ingest."""
    incoming = field_of(batch, field.name)
    value = plain_cast(col(incoming.name), incoming.dataType, field.dataType)
    if incoming.dataType == field.dataType:
        return value
    lost = col(incoming.name).isNotNull() & value.isNull()
    message = F.concat(F.lit(f"column {field.name!r} cannot hold "), col(incoming.name).cast("string"))
    return F.when(lost, F.raise_error(message)).otherwise(value)


def _publish(rows, before, spec, landed, full, method, n_order, notes) -> IngestResult:
    """``full`` are the batch's rows in registered types and their order, read from the part ``landed``."""
    fields = _stored_fields(spec)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    order = [F.col(f"__o{i}") for i in range(n_order)]
    base = rows.read(before).select(schema.names) if before else rows.spark.createDataFrame([], schema)
    old_parts = before.parts if before else ()
    key = field_of(full, spec.key).name
    total = full.count()
    held = _held(rows, before)

    if method == "append":
        conflict = K.append_conflicts(base, full.select(col(key)), key).first()
        if conflict is not None:
            rows.drop_part(landed)
            return IngestResult(error=f"key {conflict['key']!r} violates the key of {spec.name!r}: {conflict['reason']}")
        added = rows.write_parts(full.select(schema.names), key)
        rows.drop_part(landed)
        version = rows.commit([*old_parts, *added], schema, before, n_rows=held + total, **notes)
        return IngestResult(rows_ingested=total, version=version.number)

    if full.filter(col(key).isNull()).first() is not None:
        rows.drop_part(landed)
        return IngestResult(error=f"NULL in the key of {spec.name!r}")

    if method == "skip":
        # The base is read once, for the keys of the batch it has; those are kept for the caller.
        taken = rows.write_part(K.skipped_keys(base, full, key))
        skipped = rows.spark.read.schema(T.StructType([schema[key]])).parquet(rows.folder.url(f"parts/{taken}"))
        n_skipped = skipped.count()
        fresh = K.first_rows(K.kept_rows(full, skipped, key), key, order).select(schema.names)
        added = rows.write_parts(fresh, key) if n_skipped < total else []
        rows.drop_part(landed)
        version = rows.commit(
            [*old_parts, *added], schema, before, n_rows=held + rows.count_parts(added, schema), **notes
        )
        return IngestResult(rows_ingested=total - n_skipped, skipped=skipped, version=version.number)

    added = rows.write_parts(K.first_rows(full, key, order).select(schema.names), key)
    rows.drop_part(landed)
    fresh = rows.read_parts(added, schema)
    parts, touched, gone = _rewrite_touched(rows, before, fresh, key, schema)
    version = rows.commit(
        [*parts, *added],
        schema,
        before,
        replaced_parts=touched,
        n_rows=held - gone + rows.count_parts(added, schema),
        **notes,
    )
    return IngestResult(rows_ingested=total, version=version.number)


def _held(rows: VersionedTable, before: Version | None) -> int:
    """Rows of a version: written in its notes, or else counted from the footers."""
    if before is None:
        return 0
    known = before.notes.get("n_rows")
    return known if known is not None else rows.count_parts(before.parts, before.schema)


def _rewrite_touched(
    rows: VersionedTable, before: Version | None, fresh: DataFrame, key: str, schema: T.StructType
) -> tuple[list[str], int, int]:
    """Rewrite only the parts that hold a replaced key; the others stay in the new version. Also returns how
    many parts and rows were replaced.

    Finding them reads the key column alone, where the footers allow a key of the batch's range, and yields at
    most one name per part.
    """
    if before is None or not before.parts:
        return [], 0, 0
    span = fresh.agg(F.min(col(key)).alias("low"), F.max(col(key)).alias("high")).first()
    if span["low"] is None:
        return list(before.parts), 0, 0
    low, high = (F.lit(x).cast(schema[key].dataType) for x in span)
    base = rows.read(before).filter(col(key).between(low, high))
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/parts/(.+)/[^/]+$", 1)
    located = base.select(col(key), F.url_decode(part).alias(_PART))
    hit = K.replaced_rows(located, fresh, key).groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    touched = {row[_PART]: row["n"] for row in hit.collect()}
    untouched = [p for p in before.parts if p not in touched]
    if not touched:
        return untouched, 0, 0
    old = rows.read_parts([p for p in before.parts if p in touched], schema)
    return [*untouched, *rows.write_parts(K.kept_rows(old, fresh, key), key)], len(touched), sum(touched.values())


class GroupResult(dict):
    """Results by table, and ``unmatched``: a frame of the files that belong to none (path, length, stem)."""

    def __init__(self, results: dict[str, IngestResult], unmatched: DataFrame):
        super().__init__(results)
        self.unmatched = unmatched


def ingest_group(store: TableStore, folder: str, glob: str = "*.csv", **options) -> GroupResult:
    """Ingest every file of a folder into the table its name matches, one batch per table. Files that match
    no table are listed in the result."""
    specs = store.specs()
    listing = match_tables(list_files(store.spark, folder, glob), [(s.name, s.pattern) for s in specs])
    results = {}
    for spec in specs:
        # The names of one group are file metadata, as in any directory listing.
        names = [r["path"] for r in listing.filter(F.col("table_name") == spec.name).orderBy("path").collect()]
        if names:
            results[spec.name] = ingest_csv(store, spec.name, names, **options)
    return GroupResult(results, listing.filter("table_name IS NULL").select("path", "length", "stem"))
