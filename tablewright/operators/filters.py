"""Row filters: one-condition filters and AND/OR groups of date ranges.

Every filter is one boolean Column, so conjuncts over stored columns reach the Parquet scan.
A NULL condition never passes a row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PlanError
from tablewright.naming import col, field_of
from tablewright.operators.casts import to_text
from tablewright.operators.literals import literal_for
from tablewright.types import type_name

# The filter operators.
COMPARISONS = ("eq", "neq", "gt", "gte", "lt", "lte")
TEXT_OPERATORS = ("contains", "not_contains")
NULL_OPERATORS = ("is_null", "is_not_null")
OPERATORS = COMPARISONS + TEXT_OPERATORS + NULL_OPERATORS

# The column types a date range accepts.
DATE_TYPES = ("DATE", "TIMESTAMP", "TIMESTAMPTZ")

_COMPARE = {
    "eq": Column.__eq__,
    "neq": Column.__ne__,
    "gt": Column.__gt__,
    "gte": Column.__ge__,
    "lt": Column.__lt__,
    "lte": Column.__le__,
}


def condition(df: DataFrame, column: str, operator: str, value=None) -> Column:
    """The boolean Column of one filter condition; NULL where the reference value is NULL."""
    field = field_of(df, column)
    target = col(field.name)
    if operator == "is_null":
        return target.isNull()
    if operator == "is_not_null":
        return target.isNotNull()
    if operator in TEXT_OPERATORS:
        # `%` and `_` in the value stay wildcards; only the escape character is neutralized.
        like = to_text(target, field.dataType).like("%" + str(value).replace("\\", "\\\\") + "%")
        return like if operator == "contains" else ~like
    return _COMPARE[operator](target, literal_for(value, field.dataType))


@dataclass(frozen=True)
class Filter:
    """Keep rows where ``column operator value`` holds."""

    column: str
    operator: str
    value: object = None

    kind = "filter"
    tail_rank = 0
    keeps_rows = False

    def __post_init__(self):
        if not self.column:
            raise PlanError("a filter needs a column")
        if self.operator not in OPERATORS:
            raise PlanError(f"unknown filter operator {self.operator!r}; use one of {OPERATORS}")
        if self.operator not in NULL_OPERATORS and self.value in (None, ""):
            raise PlanError(f"filter operator {self.operator!r} needs a value")

    def predicate(self, df: DataFrame) -> Column:
        return condition(df, self.column, self.operator, self.value)

    def apply(self, df: DataFrame, tables=None) -> DataFrame:
        return df.filter(self.predicate(df))


@dataclass(frozen=True)
class DateCondition:
    """``start <= day(column) <= end``, both ends included; an absent bound is open."""

    column: str
    start: str | dt.date | None = None
    end: str | dt.date | None = None

    def __post_init__(self):
        if not self.column:
            raise PlanError("a date condition needs a column")
        first, last = self._day(self.start), self._day(self.end)
        if first is None and last is None:
            raise PlanError(f"the date condition on {self.column!r} has no bound")
        if first is not None and last is not None and first > last:
            raise PlanError(f"the date condition on {self.column!r} starts after it ends")

    def _day(self, bound) -> dt.date | None:
        if bound in (None, ""):
            return None
        if isinstance(bound, dt.date):
            return bound
        try:
            return dt.date.fromisoformat(bound)
        except ValueError as cause:
            raise PlanError(f"{bound!r} is not a YYYY-MM-DD date") from cause

    def predicate(self, df: DataFrame) -> Column:
        field = field_of(df, self.column)
        if type_name(field.dataType) not in DATE_TYPES:
            raise PlanError(
                f"{self.column!r} is {type_name(field.dataType)}; a date range needs one of {DATE_TYPES}"
            )
        day = col(field.name) if isinstance(field.dataType, T.DateType) else col(field.name).cast("date")
        first, last = self._day(self.start), self._day(self.end)
        bounds = []
        if first is not None:
            bounds.append(day >= F.lit(first))
        if last is not None:
            bounds.append(day <= F.lit(last))
        return reduce(and_, bounds)


def any_of_all(groups: list[list[Column]]) -> Column:
    """Conditions AND inside a group, groups OR. A row filter already drops NULL, and OR
    keeps a row that passes another group, so the result equals reading NULL as false."""
    return reduce(or_, [reduce(and_, group) for group in groups])


@dataclass(frozen=True)
class DateRange:
    """Keep rows that satisfy every condition of at least one group."""

    groups: tuple[tuple[DateCondition, ...], ...]

    kind = "date_range"
    tail_rank = 1
    keeps_rows = False

    def __post_init__(self):
        frozen = tuple(tuple(group) for group in self.groups)
        object.__setattr__(self, "groups", frozen)
        if not frozen or not all(frozen):
            raise PlanError("a date range needs at least one group, each with a condition")

    def predicate(self, df: DataFrame) -> Column:
        return any_of_all([[c.predicate(df) for c in group] for group in self.groups])

    def apply(self, df: DataFrame, tables=None) -> DataFrame:
        return df.filter(self.predicate(df))
