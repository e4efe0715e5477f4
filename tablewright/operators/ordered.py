"""Running values of whole columns in a global order, without a task that sees the whole column."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tablewright.errors import PlanError
from tablewright.naming import col, field_of

_PART, _TIE = "__part", "__tie"


@dataclass(frozen=True)
class Scan:
    """A running value: inside a part, of a whole part, and how the two combine."""

    inside: Callable[[Column, WindowSpec], Column]
    whole: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# NULLs count for nothing, as in SQL.
SCANS = {
    "running_sum": Scan(lambda x, w: F.sum(x).over(w), lambda x: F.sum(x), _either),
    "running_count": Scan(lambda x, w: F.count(x).over(w), lambda x: F.count(x), _either),
    "running_min": Scan(lambda x, w: F.min(x).over(w), lambda x: F.min(x), F.least),
    "running_max": Scan(lambda x, w: F.max(x).over(w), lambda x: F.max(x), F.greatest),
    "row_number": Scan(lambda x, w: F.count(F.lit(1)).over(w), lambda x: F.count(F.lit(1)), _either),
}
PREVIOUS = "previous"


def running(df: DataFrame, order: list[str], columns: dict[str, tuple[str, str | None]], folder: str) -> DataFrame:
    """``df`` and new columns ``{name: (scan, column)}`` over all rows up to and including each row in ``order``.

    The scans are ``running_sum``, ``running_count``, ``running_min``, ``running_max``, ``row_number`` (of no
    column) and ``previous``, the column's value in the row before. NULLs of ``order`` come first; rows that
    tie in it are taken in the order of a hash of all their columns, so the result doesn't depend on how
    rows are dealt; rows equal in every column get their values in any order. No rows, no rows.

    Rows are dealt by ranges of the order to tasks and written once below ``folder``, so a task that runs again
    sees the same ranges. Each part is reduced to one row; those rows, one for each shuffle partition, are
    scanned by themselves, and what comes before a part is added to the running values inside it. Ties are
    spread over ranges by the hash, so no value of ``order`` fills a task.
    """
    for name, (scan, column) in columns.items():
        if scan not in SCANS and scan != PREVIOUS:
            raise PlanError(f"unknown scan {scan!r} for {name!r}; use one of {[*SCANS, PREVIOUS]}")
        if column is None and scan != "row_number":
            raise PlanError(f"{scan!r} needs a column")
    inputs = {n: F.lit(None) if c is None else col(field_of(df, c).name) for n, (_, c) in columns.items()}
    positions = [col(field_of(df, o).name) for o in order]
    tied = df.withColumn(_TIE, F.xxhash64(*[_hashable(df, c) for c in df.columns]))
    sorting = [*[p.asc_nulls_first() for p in positions], F.col(_TIE).asc()]
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    tied.repartitionByRange(*sorting).withColumn(_PART, F.spark_partition_id()).write.parquet(path)
    schema = tied.withColumn(_PART, F.lit(0)).schema
    parts = df.sparkSession.read.schema(schema).parquet(path)

    at = F.struct(*[F.struct(p.isNotNull(), p) for p in positions], F.col(_TIE))
    wholes = [F.max_by(F.struct(x.alias("v")), at) if columns[n][0] == PREVIOUS else SCANS[columns[n][0]].whole(x) for n, x in inputs.items()]
    totals = parts.groupBy(_PART).agg(*[w.alias(f"__w_{n}") for n, w in zip(inputs, wholes, strict=True)])
    # One row for each part: their number is that of the shuffle partitions.
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(_PART, *[_ahead(columns[n][0], F.col(f"__w_{n}"), earlier).alias(f"__a_{n}") for n in inputs])

    inside = Window.partitionBy(_PART).orderBy(*sorting)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(inside) == 1
    out = []
    for n, x in inputs.items():
        scan, before = columns[n][0], F.col(f"__a_{n}")
        if scan == PREVIOUS:
            value = F.when(first, before.getField("v")).otherwise(F.lag(x).over(inside))
        else:
            value = SCANS[scan].combine(before, SCANS[scan].inside(x, upto))
        out.append(value.alias(n))
    return parts.join(ahead, _PART).select(*[col(c) for c in df.columns], *out)


def _ahead(scan: str, whole: Column, earlier: WindowSpec) -> Column:
    """What the parts before a part come to."""
    if scan == PREVIOUS:
        return F.last(whole).over(earlier)
    if scan in ("running_min", "running_max"):
        return (F.min if scan == "running_min" else F.max)(whole).over(earlier)
    return F.sum(whole).over(earlier)


def _hashable(df: DataFrame, name: str) -> Column:
    return F.to_json(F.struct(col(name))) if "map<" in df.schema[name].dataType.simpleString() else col(name)
