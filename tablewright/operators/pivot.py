"""Pivot: one row per index tuple, one column per value of the pivot column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PlanError
from tablewright.naming import col, distinct_names, field_of
from tablewright.operators.casts import to_text

# The pivot aggregations.
AGGREGATIONS = ("sum", "avg", "min", "max", "count")

_AGGREGATE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
_PIVOT = "__pivot"


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """The distinct non-null values as text, sorted. They become column names, so their number is
    bounded by ``spark.sql.pivotMaxValues``; more is an error, never a cut."""
    field = field_of(df, column)
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    text = to_text(col(field.name), field.dataType).alias("v")
    rows = df.select(text).filter("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise PlanError(f"{column!r} has more than {limit} distinct values; raise spark.sql.pivotMaxValues")
    return sorted(row["v"] for row in rows)


def pivot(
    df: DataFrame,
    index: Sequence[str],
    column: str,
    aggregates: Sequence[tuple[str, str]],
    values: Sequence[str] | None = None,
) -> DataFrame:
    """``aggregates`` are (value column, aggregation) pairs.

    One pair names its columns after the pivot values, several append ``_sum(amt)``. A NULL pivot
    value makes no column but keeps its index row. Without an index, rows are grouped by every
    column that is neither pivoted nor aggregated. All aggregations combine map-side, so a hot
    index value does not collect in one task.
    """
    pivot_field = field_of(df, column)
    pairs = [(field_of(df, name).name, how) for name, how in aggregates]
    if index:
        groups = [field_of(df, name).name for name in index]
    else:
        used = {pivot_field.name, *(name for name, _ in pairs)}
        groups = [name for name in df.columns if name not in used]
    if values is None:
        values = pivot_values(df, column)
    if not values:
        return df.select([col(g) for g in groups]).distinct()

    # The same pair twice is computed once and projected twice.
    unique = list(dict.fromkeys(pairs))
    needed = list(dict.fromkeys(name for name, _ in unique))
    narrow = df.select(
        *[col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        *[col(c) for c in needed],
        to_text(col(pivot_field.name), pivot_field.dataType).alias(_PIVOT),
    )
    keys = [f"__g{i}" for i in range(len(groups))]
    slots = {(v, pair): f"__c{i}_{j}" for i, v in enumerate(values) for j, pair in enumerate(unique)}
    aggs = [_AGGREGATE[how](col(name)).alias(f"a{j}") for j, (name, how) in enumerate(unique)]
    # Spark first aggregates per (index, value), so no row is tested against every value. Cells are addressed
    # by position: values that differ only in case are legal.
    wide = narrow.groupBy(keys).pivot(_PIVOT, list(values)).agg(*aggs).toDF(*keys, *slots.values())

    cells: list[tuple[str, Column]] = []
    for value in values:
        for name, how in pairs:
            cell = F.col(slots[value, (name, how)])
            if how == "count":
                cell = F.coalesce(cell, F.lit(0).cast("long"))
            cells.append((value if len(pairs) == 1 else f"{value}_{how}({name})", cell))
    names = distinct_names([*groups, *(name for name, _ in cells)])
    exprs = [*(F.col(k) for k in keys), *(cell for _, cell in cells)]
    return wide.select([e.alias(n) for e, n in zip(exprs, names, strict=True)])


@dataclass(frozen=True)
class Pivot:
    """``values`` maps a value column to its aggregations; none listed means ``sum``."""

    column: str
    values: Mapping[str, Sequence[str]] | Sequence[tuple[str, Sequence[str]]]
    index: tuple[str, ...] = ()
    pivot_values: tuple[str, ...] | None = None

    kind = "pivot"
    tail_rank = 0
    keeps_rows = False

    def __post_init__(self):
        if not self.column:
            raise PlanError("a pivot needs a pivot column")
        entries = self.values.items() if isinstance(self.values, Mapping) else self.values
        pairs = [(name, how) for name, hows in entries for how in (hows or ("sum",))]
        if not pairs or not all(name for name, _ in pairs):
            raise PlanError("a pivot needs at least one value column")
        unknown = sorted({how for _, how in pairs if how not in AGGREGATIONS})
        if unknown:
            raise PlanError(f"unknown aggregations {unknown}; use {AGGREGATIONS}")
        object.__setattr__(self, "pairs", tuple(pairs))

    def apply(self, df: DataFrame, tables=None) -> DataFrame:
        return pivot(df, self.index, self.column, self.pairs, self.pivot_values)
