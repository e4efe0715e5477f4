"""Equality joins between a table and a raw or transformed table.

No side is ever hinted as broadcast: Catalyst and AQE broadcast a side whose measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merge otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PlanError
from tablewright.naming import col, distinct_names, field_of
from tablewright.operators.casts import plain_cast
from tablewright.operators.skew import equal_keys, split_join

# The join types.
JOIN_TYPES = ("inner", "left", "right", "full")
# How an outer join is built: see ``equi_join``.
SKEW = ("auto", "plain", "split")


def _common_type(df: DataFrame, left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which Spark compares two types; only analyzed."""
    pair = df.sparkSession.range(0).select(F.lit(None).cast(left).alias("a"), F.lit(None).cast(right).alias("b"))
    return pair.select(F.coalesce("a", "b").alias("c")).schema["c"].dataType


def _converted(df: DataFrame, left: T.StructField, right: T.StructField) -> tuple[Column | None, Column | None]:
    """Key expressions that differ from the stored columns: text keys are read as the other
    side's type, so ``'1'`` matches ``1``, and other types meet in their common type, so that
    equal keys have equal hashes."""
    text_left, text_right = isinstance(left.dataType, T.StringType), isinstance(right.dataType, T.StringType)
    if text_left and not text_right:
        return plain_cast(col(left.name), left.dataType, right.dataType), None
    if text_right and not text_left:
        return None, plain_cast(col(right.name), right.dataType, left.dataType)
    if left.dataType == right.dataType:
        return None, None
    common = _common_type(df, left.dataType, right.dataType)
    return tuple(None if f.dataType == common else col(f.name).cast(common) for f in (left, right))


def _side(df: DataFrame, names: dict[str, str], keys: list[tuple[str, Column | None]], tag: str):
    """The side's columns under their output names, and the names of its key columns. A key is
    carried as an extra column only if it is converted or pruned."""
    extra, key_names = [], []
    for i, (name, converted) in enumerate(keys):
        if converted is None and name in names:
            key_names.append(names[name])
        else:
            extra.append((col(name) if converted is None else converted).alias(f"__{tag}k{i}"))
            key_names.append(f"__{tag}k{i}")
    return df.select(*[col(c).alias(n) for c, n in names.items()], *extra), key_names


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str = "inner",
    keep: str | Sequence[str] = "all",
    skew: str = "auto",
    unique: Sequence[str] = (),
) -> DataFrame:
    """All left columns, then all right columns; both copies of a key are kept.

    A repeated name gets ``_1``, ``_2``…. NULL keys never match. ``keep`` prunes the right side.
    ``skew="split"`` composes an outer join of an inner and anti joins, which AQE can split on hot
    keys; ``"plain"`` leaves it as it is. ``"auto"`` is plain where the side that AQE cannot split
    has no hot key, since its join key is known to be ``unique`` ("left", "right").
    """
    left_keys = [field_of(left, a) for a, _ in on]
    right_keys = [field_of(right, b) for _, b in on]
    kept = right.columns if keep == "all" else [field_of(right, name).name for name in keep]
    names = distinct_names([*left.columns, *kept])
    left_out, right_out = names[: len(left.columns)], names[len(left.columns) :]

    conversions = [_converted(left, a, b) for a, b in zip(left_keys, right_keys, strict=True)]
    lks = [(f.name, x) for f, (x, _) in zip(left_keys, conversions, strict=True)]
    rks = [(f.name, y) for f, (_, y) in zip(right_keys, conversions, strict=True)]
    l_side, lk = _side(left, dict(zip(left.columns, left_out, strict=True)), lks, "l")
    r_side, rk = _side(right, dict(zip(kept, right_out, strict=True)), rks, "r")

    fixed = {"inner": (), "left": ("right",), "right": ("left",), "full": ("left", "right")}[how]
    if skew == "split" or (skew == "auto" and not set(fixed) <= set(unique)):
        joined = split_join(l_side, r_side, lk, rk, how)
    else:
        joined = l_side.join(r_side, equal_keys(lk, rk), how)
    return joined.select([col(n) for n in names])


@dataclass(frozen=True)
class Join:
    """Join the working table to another table of the workspace (or to a DataFrame)."""

    right: str | DataFrame
    on: tuple[tuple[str, str], ...]
    how: str = "inner"
    use_transformed: bool = False
    keep_columns: str | tuple[str, ...] = "all"
    skew: str = "auto"
    # Sides ("left", "right") in which no two rows have the same join key.
    unique: tuple[str, ...] = ()

    kind = "join"
    tail_rank = 0
    keeps_rows = False

    def __post_init__(self):
        if isinstance(self.right, str) and not self.right:
            raise PlanError("a join needs a right table")
        if self.how not in JOIN_TYPES:
            raise PlanError(f"unknown join type {self.how!r}; use one of {JOIN_TYPES}")
        if self.skew not in SKEW:
            raise PlanError(f"unknown skew {self.skew!r}; use one of {SKEW}")
        pairs = tuple((a, b) for a, b in self.on)
        if not pairs or not all(a and b for a, b in pairs):
            raise PlanError("a join needs at least one (left column, right column) pair")
        object.__setattr__(self, "on", pairs)

    def apply(self, df: DataFrame, tables=None) -> DataFrame:
        return self.apply_with_lineage(df, tables)[0]

    def apply_with_lineage(self, df: DataFrame, tables=None) -> tuple[DataFrame, str | None]:
        """The joined table and the id of the transformed output it read, if any."""
        unique = self.unique
        if isinstance(self.right, DataFrame):
            right, consumed = self.right, None
        elif tables is None:
            raise PlanError(f"no workspace to find table {self.right!r} in")
        else:
            right, consumed = tables.resolve(self.right, "transformed" if self.use_transformed else "raw")
            key = None if self.use_transformed else tables.unique_key(self.right)
            if key is not None and key.lower() in {b.lower() for _, b in self.on}:
                unique = (*unique, "right")
        joined = equi_join(df, right, self.on, self.how, self.keep_columns, self.skew, unique)
        return joined, consumed
