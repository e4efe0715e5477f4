"""User functions: native expressions, Python bodies over Arrow batches, tables, and SQL.

A transform computes columns or a table, a validation computes one boolean per row or per table.
Native forms (``ColumnFunction``, ``ValueFunction``, ``TableFunction``, ``SqlFunction``) stay
in the JVM; ``RowFunction`` and ``SeriesFunction`` ship columns to Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PlanError
from tablewright.faults import raised_by
from tablewright.functions.binding import PARAM_TYPES, Call
from tablewright.naming import col, field_of, quoted

# What a function is for.
KINDS = ("transform", "validation")


@dataclass(frozen=True, kw_only=True)
class UserFunction:
    """``params`` maps parameter names to their types; ``defaults`` gives values for scalars."""

    name: str
    params: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    kind: str = "transform"

    # How the result is placed: per row in a column, one value for the table, or a new table.
    shape = "column"
    # Only SQL names its input and other tables in parameters.
    names_tables = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise PlanError(f"a function is one of {KINDS}, not {self.kind!r}")
        bad = {n: t for n, t in self.params.items() if t not in PARAM_TYPES}
        if bad:
            raise PlanError(f"unknown parameter types {bad}; use {PARAM_TYPES}")
        if not self.names_tables and {"table", "source"} & set(self.params.values()):
            raise PlanError("only a SqlFunction has table and source parameters")
        extra = [n for n in self.defaults if self.params.get(n) not in ("int", "float", "bool", "str", "date")]
        if extra:
            raise PlanError(f"only scalar parameters have defaults, not {extra}")

    def arguments(self, df: DataFrame, call: Call) -> dict[str, Column]:
        return {param: col(field_of(df, name).name) for param, name in call.columns.items()}

    def attach(self, df: DataFrame, call: Call, name: str) -> DataFrame:
        """The frame with the function's result in a new column."""
        return df.withColumn(name, self.expression(df, call))

    def expression(self, df: DataFrame, call: Call) -> Column:
        raise NotImplementedError

    def check_boolean(self, dtype: T.DataType) -> None:
        if self.kind == "validation" and not isinstance(dtype, T.BooleanType):
            raise PlanError(f"validation {self.name!r} returns {dtype.simpleString()}, not boolean")


@dataclass(frozen=True, kw_only=True)
class ColumnFunction(UserFunction):
    """``fn(**columns, **values) -> Column`` from built-in Spark expressions."""

    fn: Callable[..., Column]

    def expression(self, df, call):
        return self.fn(**self.arguments(df, call), **call.values)


@dataclass(frozen=True, kw_only=True)
class RowFunction(UserFunction):
    """``fn(**cells, **values)`` called for each row; NULL arrives as ``None``."""

    fn: Callable[..., object]
    returns: str | T.DataType = "string"

    def expression(self, df, call):
        names = list(call.columns)
        run = udf_over(guarded(self.fn, self.name), names, dict(call.values))
        args = self.arguments(df, call)
        return F.udf(run, self.returns, useArrow=True)(*[args[n] for n in names])


@dataclass(frozen=True, kw_only=True)
class SeriesFunction(UserFunction):
    """``fn(**series, **values) -> pandas.Series`` computed row by row over Arrow batches.

    A batch is not the whole column, so the body must treat rows independently, and says so with
    ``rowwise=True``. Statistics of a whole column belong in a ``ColumnFunction`` or
    ``ValueFunction``, which Spark aggregates.
    """

    fn: Callable[..., pd.Series]
    returns: str | T.DataType = "double"
    rowwise: bool = False

    def __post_init__(self):
        super().__post_init__()
        if not self.rowwise:
            raise PlanError(f"{self.name!r} must declare rowwise=True: it sees batches, never the whole column")

    def expression(self, df, call):
        names = list(call.columns)
        run = udf_over(guarded(self.fn, self.name), names, dict(call.values))

        def batch(*series: pd.Series) -> pd.Series:
            return run(*series)

        args = self.arguments(df, call)
        return F.pandas_udf(batch, self.returns)(*[args[n] for n in names])


def guarded(fn: Callable, name: str) -> Callable:
    """The function with its exceptions marked as its own, so that a run can tell them from the machinery's."""

    def run(*args, **values):
        try:
            return fn(*args, **values)
        except MemoryError:
            raise
        except Exception as cause:
            raise raised_by(name, cause) from None

    return run


def udf_over(fn: Callable, names: list[str], values: dict) -> Callable:
    """Positional arguments back to the keywords the user function expects."""

    def run(*args):
        return fn(**dict(zip(names, args, strict=True)), **values)

    return run


@dataclass(frozen=True, kw_only=True)
class ValueFunction(UserFunction):
    """``fn(**values) -> Column``, an aggregate of the whole table.

    As a transform its value fills a new column; as a validation it passes or fails the table.
    """

    fn: Callable[..., Column]
    shape = "value"

    def expression(self, df, call):
        return self.fn(**call.values)


@dataclass(frozen=True, kw_only=True)
class TableFunction(UserFunction):
    """``fn(frame, **values) -> DataFrame``; the result replaces the working table."""

    fn: Callable[..., DataFrame]
    shape = "table"

    def table(self, df, call, tables=None):
        return df.transform(partial(self.fn, **call.values))


@dataclass(frozen=True, kw_only=True)
class ChunkFunction(UserFunction):
    """``fn(pandas.DataFrame, **values) -> pandas.DataFrame`` for bodies that work on any slice
    of the table; the chunks are Arrow batches and never a whole table or group."""

    fn: Callable[..., pd.DataFrame]
    schema: str | T.StructType
    shape = "table"

    def table(self, df, call, tables=None):
        fn, values = guarded(self.fn, self.name), dict(call.values)

        def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield fn(batch, **values)

        return df.mapInPandas(chunks, self.schema)


@dataclass(frozen=True, kw_only=True)
class SqlFunction(UserFunction):
    """A Spark SQL query (transform) or boolean row expression (validation).

    ``{source_table}`` or a table parameter names the input, a source parameter another table's raw
    rows. Values are bound as
    ``:param``, columns as ``IDENTIFIER(:param)`` after a check against the input's columns.
    A query without parameters reads the raw table even behind other steps; ``reads`` overrides.
    """

    text: str
    reads: str | None = None
    names_tables = True

    def __post_init__(self):
        super().__post_init__()
        if not self.text.strip():
            raise PlanError(f"SQL function {self.name!r} has no text")
        if self.reads not in (None, "raw", "working"):
            raise PlanError("reads is 'raw' or 'working'")

    @property
    def shape(self):
        return "column" if self.kind == "validation" else "table"

    @property
    def reads_raw(self) -> bool:
        return self.reads == "raw" or (self.reads is None and not self.params)

    def _arguments(self, df: DataFrame, call: Call) -> dict[str, object]:
        names = {param: quoted(field_of(df, name).name) for param, name in call.columns.items()}
        return {**names, **call.values}

    def table(self, df, call, tables=None):
        others = {param: df for param, kind in self.params.items() if kind == "table"}
        for param, table in call.sources.items():
            if tables is None:
                raise PlanError(f"no workspace to find table {table!r} in")
            others[param] = tables.raw(table)
        return df.sparkSession.sql(self.text, args=self._arguments(df, call), source_table=df, **others)

    def attach(self, df, call, name):
        query = f"SELECT *, ({self.text}) AS {quoted(name)} FROM {{source_table}}"
        return df.sparkSession.sql(query, args=self._arguments(df, call), source_table=df)
