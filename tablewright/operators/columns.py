"""Column projections: simultaneous rename and placement of computed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tablewright.errors import PlanError, UnknownColumnError
from tablewright.naming import col, unused_name


@dataclass(frozen=True)
class Rename:
    """Rename columns all at once, so swaps and chains are legal."""

    renames: Mapping[str, str]

    kind = "rename"
    tail_rank = 2
    keeps_rows = True

    def __post_init__(self):
        targets = list(self.renames.values())
        if not targets:
            raise PlanError("a rename needs at least one column")
        for old, new in self.renames.items():
            if not str(old).strip() or not str(new).strip():
                raise PlanError("rename names must not be empty")
        if len({t.lower() for t in targets}) != len(targets):
            raise PlanError("two columns cannot be renamed to the same name")

    def apply(self, df: DataFrame, tables=None) -> DataFrame:
        wanted = {old.lower(): new for old, new in self.renames.items()}
        present = {name.lower() for name in df.columns}
        for old in self.renames:
            if old.lower() not in present:
                raise UnknownColumnError(old, df.columns)
        kept = present - set(wanted)
        clashes = sorted(new for new in wanted.values() if new.lower() in kept)
        if clashes:
            raise PlanError(f"rename targets already exist: {clashes}")
        return df.select([col(name).alias(wanted.get(name.lower(), name)) for name in df.columns])


def append_columns(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add columns after the existing ones; a taken name gets ``_2``, ``_3``…"""
    added: dict[str, Column] = {}
    for name, expression in columns:
        added[unused_name(name, [*df.columns, *added])] = expression
    return df.withColumns(added)


def replace_columns(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """Overwrite columns. All expressions read the input, never an already replaced value.

    A later write to the same target wins; a target that does not exist is created.
    """
    existing = {name.lower(): name for name in df.columns}
    final: dict[str, Column] = {}
    for name, expression in columns:
        final[existing.get(name.lower(), name)] = expression
    return df.withColumns(final)


def broadcast_scalar(df: DataFrame, name: str, aggregate: Column, over: DataFrame | None = None) -> DataFrame:
    """Fill a new column with one aggregate of the whole table.

    The aggregate is a scalar subquery: two-phase, one value back, no window and no cross join.
    """
    source = over if over is not None else df
    value = source.agg(aggregate.alias("value")).scalar()
    return append_columns(df, [(name, value)])
