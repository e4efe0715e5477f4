"""Validation verdicts: all counts of a table in one aggregate, failing rows as frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.binding import Call
from tablewright.functions.user import UserFunction
from tablewright.naming import col, field_of
from tablewright.operators.casts import to_text
from tablewright.sources.export import json_safe, row_json


@dataclass(frozen=True)
class Check:
    """One validation with one argument bundle, over the rows of ``base``."""

    result_id: str
    function: UserFunction
    call: Call

    @property
    def per_row(self) -> bool:
        return self.function.shape != "value"


def with_verdicts(base: DataFrame, checks: list[Check]) -> DataFrame:
    """The rows with one verdict column ``__v<i>`` per row-level check."""
    for i, check in enumerate(checks):
        if check.per_row:
            base = check.function.attach(base, check.call, f"__v{i}")
    return base


def verify(base: DataFrame, check: Check) -> None:
    """Analyze a check without running it; raises when it cannot be planned."""
    if check.per_row:
        probed = check.function.attach(base, check.call, "__v")
    else:
        probed = base.agg(check.function.expression(base, check.call).alias("__v"))
    check.function.check_boolean(field_of(probed, "__v").dataType)


def passed(verdict: str) -> Column:
    """A NULL verdict has not passed."""
    return F.coalesce(F.col(verdict), F.lit(False))


def count_columns(base: DataFrame, checks: list[Check]) -> list[tuple[Column, Column]]:
    """Per check the (passed, failed) aggregates over :func:`with_verdicts`.

    A table-level check counts as one passed or one failed row.
    """
    columns = []
    for i, check in enumerate(checks):
        if check.per_row:
            good = F.count_if(passed(f"__v{i}"))
            columns.append((good, F.count(F.lit(1)) - good))
        else:
            good = F.coalesce(check.function.expression(base, check.call), F.lit(False)).cast("long")
            columns.append((good, F.lit(1) - good))
    return columns


def verdict_counts(base: DataFrame, checks: list[Check]) -> DataFrame:
    """``result_id, rows_passed, rows_failed, pass_rate`` of all checks in one pass."""
    if not checks:
        return base.sparkSession.createDataFrame(
            [], "result_id string, rows_passed long, rows_failed long, pass_rate double"
        )
    rows = [
        F.struct(F.lit(c.result_id).alias("result_id"), good.alias("rows_passed"), bad.alias("rows_failed"))
        for c, (good, bad) in zip(checks, count_columns(base, checks), strict=True)
    ]
    one = with_verdicts(base, checks).agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return one.withColumn("pass_rate", pass_rate(F.col("rows_passed"), F.col("rows_failed")))


def pass_rate(good: Column, bad: Column) -> Column:
    """Share of passed rows; NULL for no rows."""
    return F.when(good + bad > 0, good / (good + bad))


def failing_rows(base: DataFrame, check: Check) -> DataFrame:
    """The full source rows that did not pass one check. A table-level check has none."""
    if not check.per_row:
        return base.limit(0)
    rows = check.function.attach(base, check.call, "__v")
    return rows.filter(~passed("__v")).drop("__v")


def all_failing_rows(base: DataFrame, checks: list[Check], key: str) -> DataFrame:
    """``result_id, key, row_json`` of every failing row of every check, in one pass."""
    per_row = [(i, c) for i, c in enumerate(checks) if c.per_row]
    field = field_of(base, key)
    ids = F.array_compact(
        F.array(F.lit(None).cast("string"), *[F.when(~passed(f"__v{i}"), F.lit(c.result_id)) for i, c in per_row])
    )
    rows = with_verdicts(base, checks).withColumn("__failed", ids)
    # Verdicts see the original numbers, and rows that pass everything are dropped before any
    # row is serialized.
    rows = json_safe(rows.filter(F.size("__failed") > 0))
    whole = row_json(rows.select([col(c) for c in base.columns]))
    text = to_text(col(field.name), field.dataType)
    # One JSON string per row, however many checks the row fails.
    slim = rows.select("__failed", text.alias("key"), whole.alias("row_json"))
    return slim.select(F.explode("__failed").alias("result_id"), "key", "row_json")
