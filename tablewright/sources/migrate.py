"""Column type migration of stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from tablewright.naming import field_of
from tablewright.operators.casts import cast_column, castability, check_migration_type, nullified_keys
from tablewright.operators.keys import converted_key_counts, converted_key_violations
from tablewright.sources.store import TableStore
from tablewright.types import spark_type, type_name

# Which tables change, and what happens to values that cannot be converted.
SCOPES = ("this_source", "all_shared")
POLICIES = ("abort", "nullify")


@dataclass(frozen=True)
class MigrationResult:
    ok: bool
    dry_run: bool = False
    castable: int = 0
    uncastable: int = 0
    shared_tables: list[str] = field(default_factory=list)
    rows_migrated: int = 0
    nullified: DataFrame | None = None
    error: str | None = None
    reason: str | None = None
    #: Keys that the conversion would break, if the column is a key, and what breaks them (``key, n_rows, reason``).
    broken_keys: int = 0
    violations: DataFrame | None = None


@dataclass(frozen=True)
class _Counts:
    castable: int
    uncastable: int
    broken_keys: int = 0


def _counts(store: TableStore, table: str, column: str, new_type: str) -> _Counts:
    """What a conversion does to the rows of a table; if the column is its key, also to the key."""
    df = store.read(table)
    if store.spec(table).key.lower() != column.lower():
        return _Counts(*castability(df, column, new_type).first())
    row = converted_key_counts(df, column, new_type).first()
    return _Counts(row["castable"], row["uncastable"], row["repeated_keys"] + bool(row["null_rows"]))


def migrate_column(
    store: TableStore,
    table: str,
    column: str,
    new_type: str,
    scope: str = "this_source",
    on_uncastable: str = "abort",
    dry_run: bool = False,
) -> MigrationResult:
    """Convert a column of one table, or of every table sharing its name and type.

    ``abort`` looks at every table in scope before anything is written, so no table loses values
    unseen. Where the column is a table's key, converted keys that are NULL or repeat are refused under
    either policy. New contents are written first, in the table's buckets, and become visible for all
    tables in one step, so a failure leaves every table as it was. The old version stays readable, and
    ``nullified`` lists the affected keys from it.
    """
    if scope not in SCOPES or on_uncastable not in POLICIES:
        raise ValueError(f"scope is one of {SCOPES}, on_uncastable one of {POLICIES}")
    try:
        target = check_migration_type(new_type)
    except ValueError as cause:
        return MigrationResult(False, error="invalid_column_type", reason=str(cause))
    if table not in store.names():
        return MigrationResult(False, error="source_not_found", reason=f"no table named {table!r}")
    schema = {f.name.lower(): f for f in store.spec(table).schema.fields}
    if column.lower() not in schema:
        return MigrationResult(False, error="column_not_found", reason=f"{table!r} has no column {column!r}")
    if type_name(schema[column.lower()].dataType) == target:
        return MigrationResult(True)

    shared = store.sharing(table, column)
    own = _counts(store, table, column, target)
    if dry_run:
        return MigrationResult(True, True, own.castable, own.uncastable, shared, broken_keys=own.broken_keys)

    chosen = [table] if scope == "this_source" else shared
    counts = {t: own if t == table else _counts(store, t, column, target) for t in chosen}
    bad = {t: n.uncastable for t, n in counts.items() if n.uncastable}
    if bad and on_uncastable == "abort":
        reason = ", ".join(f"{n} row(s) in {t!r}" for t, n in sorted(bad.items()))
        return MigrationResult(
            False,
            castable=own.castable,
            uncastable=sum(bad.values()),
            shared_tables=shared,
            error="uncastable_rows",
            reason=f"{reason} cannot be cast to {target}",
        )
    broken = sorted(t for t, n in counts.items() if n.broken_keys)
    if broken:
        violations = {t: converted_key_violations(store.read(t), column, target) for t in broken}
        # A report of the first few; ``violations`` has all.
        named = {t: v.orderBy("reason", "key").limit(5).collect() for t, v in violations.items()}
        shown = [f"{r['reason']} key {r['key']!r} ({r['n_rows']} rows) in {t!r}" for t in broken for r in named[t]]
        return MigrationResult(
            False,
            castable=own.castable,
            uncastable=own.uncastable,
            shared_tables=shared,
            error="migration_failed",
            reason=f"as {target}, {', '.join(shown)}",
            broken_keys=sum(counts[t].broken_keys for t in broken),
            violations=reduce(DataFrame.unionByName, violations.values()),
        )

    nullified = [
        nullified_keys(store.read(t), store.spec(t).key, column, target)
        for t in chosen
        if on_uncastable == "nullify"
    ]
    try:
        migrated = _rewrite(store, chosen, column, target)
    except Exception as cause:  # noqa: BLE001 - nothing was published
        return MigrationResult(False, error="migration_failed", reason=str(cause))
    return MigrationResult(
        True,
        castable=own.castable,
        uncastable=own.uncastable,
        shared_tables=shared,
        rows_migrated=migrated,
        nullified=reduce(DataFrame.unionByName, nullified) if nullified else None,
    )


def _rewrite(store: TableStore, tables: list[str], column: str, target: str) -> int:
    """Write the new content of every table, then publish all of them in one step."""
    drafts, migrated = {}, 0
    for name in tables:
        spec, schema = store.spec(name), store.retype(name, column, spark_type(target))
        rows = store.rows(name)
        before = rows.latest()
        parts, n_rows = [], 0
        if before is not None:
            current = rows.read(before)
            parts = rows.write_parts(cast_column(current, field_of(current, column).name, target), spec.key)
            n_rows = rows.count_parts(parts, schema)
        migrated += n_rows
        drafts[name] = rows.draft(parts, schema, before, migrated=column, n_rows=n_rows)
    store.publish(drafts)
    return migrated
