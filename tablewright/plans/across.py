"""One validation, or one function set, over all the tables it is attached to."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PlanError
from tablewright.naming import normalize_label, short_id
from tablewright.plans import verdicts as V
from tablewright.plans.run import RESULT_SCHEMA, checked_calls, compose
from tablewright.plans.steps import members_of
from tablewright.plans.workspace import Workspace

ACROSS_SCHEMA = (
    "source_name string, function_name string, function_type string, label string, status string, "
    "rows_passed long, rows_failed long, pass_rate double, error string, result_id string"
)


def _members(workspace: Workspace, table: str, function: str):
    for step in workspace.steps(table):
        for member in members_of(step):
            if member.function.name == function and member.function.kind == "validation":
                yield member


def validate_across(workspace: Workspace, function: str) -> DataFrame:
    """One row per table with the function's counts summed over its bundles, by table name.

    Each table is read once, for this function alone, and all tables are counted in one job.
    A table on which the function cannot run is a failed row and stops no other table.
    """
    parts, fixed = [], []
    for table in workspace.tables_with_function(function):
        identity = (table, function, "validation", normalize_label(table))
        result_id = short_id(function, table, table)
        base, checks, error = None, [], None
        try:
            base = workspace.raw(table)
            members = list(_members(workspace, table, function))
        except Exception as cause:  # noqa: BLE001 - recorded on the row
            members, error = [], str(cause)
        for member in members:
            try:
                for call in checked_calls(member):
                    check = V.Check(result_id, member.function, call)
                    V.verify(base, check)
                    checks.append(check)
            except Exception as cause:  # noqa: BLE001 - recorded on the row, the others go on
                error = str(cause)
        status = "ok" if error is None else "failed"
        if not checks:
            fixed.append((*identity, status, None, None, None, error, result_id))
            continue
        counts = V.count_columns(base, checks)
        good = reduce(lambda a, b: a + b, [g for g, _ in counts])
        bad = reduce(lambda a, b: a + b, [b for _, b in counts])
        row = V.with_verdicts(base, checks).agg(good.alias("rows_passed"), bad.alias("rows_failed"))
        # With an error and no rows there is nothing to report but the error.
        empty = F.lit(error is not None) & (F.col("rows_passed") + F.col("rows_failed") == 0)
        shown = {n: F.when(~empty, F.col(n)) for n in ("rows_passed", "rows_failed")}
        names = ("source_name", "function_name", "function_type", "label")
        parts.append(
            row.select(
                *[F.lit(v).alias(n) for n, v in zip(names, identity, strict=True)],
                F.lit(status).alias("status"),
                *[c.cast("long").alias(n) for n, c in shown.items()],
                V.pass_rate(F.col("rows_passed"), F.col("rows_failed")).alias("pass_rate"),
                F.lit(error).cast("string").alias("error"),
                F.lit(result_id).alias("result_id"),
            )
        )
    if fixed or not parts:
        parts.append(workspace.spark.createDataFrame(fixed, ACROSS_SCHEMA))
    return reduce(DataFrame.unionByName, parts).orderBy("source_name")


def failing_rows_across(workspace: Workspace, function: str, keys: Mapping[str, str]) -> DataFrame:
    """``source_name, result_id, key, row_json`` of every row that fails the function on any of its tables.

    ``keys`` names the key column per table; a stored table has its own. One lazy union with one scan per
    table. Tables on which the function cannot run have no rows here; ``validate_across`` reports them.
    """
    parts = [workspace.spark.createDataFrame([], "source_name string, result_id string, key string, row_json string")]
    for table in workspace.tables_with_function(function):
        try:
            base = workspace.raw(table)
            calls = [(m.function, call) for m in _members(workspace, table, function) for call in checked_calls(m)]
            result_id = short_id(function, table, table)
            checks = [V.Check(result_id, fn, call) for fn, call in calls]
            for check in checks:
                V.verify(base, check)
            key = keys.get(table) or workspace.view(table).unique_key(table)
            if key is None:
                raise PlanError(f"no key named for table {table!r}")
        except (PlanError, PySparkException):
            if table not in keys and workspace.view(table).unique_key(table) is None:
                raise
            continue
        # A row is listed once, however many bundles it fails.
        rows = V.all_failing_rows(base, checks, key).distinct()
        parts.append(rows.select(F.lit(table).alias("source_name"), "result_id", "key", "row_json"))
    return reduce(DataFrame.unionByName, parts)


def run_set_across(workspace: Workspace, set_name: str) -> DataFrame:
    """Results of one set on every table that has it; a table that cannot be read is one failed
    row without a function."""
    parts, fixed = [], []
    for table in workspace.tables_with_set(set_name):
        try:
            parts.append(compose(workspace, table, "set", set_name).results())
        except Exception as cause:  # noqa: BLE001 - recorded on the row
            fixed.append((0, table, None, None, set_name, None, None, "failed") + (None,) * 4 + (str(cause), None, None))
    if fixed or not parts:
        parts.append(workspace.spark.createDataFrame(fixed, RESULT_SCHEMA))
    return reduce(DataFrame.unionByName, parts).orderBy("source_name", "step_no")
