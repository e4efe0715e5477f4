"""The closed type vocabulary, the Spark types behind it, and schema drift."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.naming import col

# The type names a table column can have, with the class used to compare them.
TYPE_CLASS = {
    "TINYINT": int,
    "SMALLINT": int,
    "INT": int,
    "INTEGER": int,
    "BIGINT": int,
    "HUGEINT": int,
    "FLOAT": float,
    "REAL": float,
    "DOUBLE": float,
    "DECIMAL": float,
    "NUMERIC": float,
    "VARCHAR": str,
    "TEXT": str,
    "DATE": str,
    "TIMESTAMP": str,
    "TIMESTAMPTZ": str,
    "BOOLEAN": bool,
    "BOOL": bool,
}

# The types a column can be migrated to.
MIGRATION_TYPES = ("INTEGER", "BIGINT", "DOUBLE", "BOOLEAN", "VARCHAR", "DATE", "TIMESTAMP")

_TO_SPARK = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DecimalType(18, 3),
    "NUMERIC": T.DecimalType(18, 3),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMPTZ": T.TimestampType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
}

_FROM_SPARK = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMPTZ",
    T.BooleanType: "BOOLEAN",
}


# A vocabulary name, with or without parameters behind it.
_NAMED = re.compile(rf"\s*({'|'.join(TYPE_CLASS)})(?:[\s(].*)?", re.IGNORECASE | re.DOTALL)


def normalize_type(raw: str | None) -> str:
    """The vocabulary name a raw type starts with, or VARCHAR for any other type."""
    named = _NAMED.fullmatch(raw or "")
    return named[1].upper() if named else "VARCHAR"


def spark_type(name: str) -> T.DataType:
    """The Spark type of a vocabulary name; ``DECIMAL(p,s)`` keeps its parameters."""
    exact = re.fullmatch(r"\s*(?:DECIMAL|NUMERIC)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*", name.upper())
    if exact:
        return T.DecimalType(int(exact.group(1)), int(exact.group(2)))
    return _TO_SPARK[normalize_type(name)]


def type_name(dtype: T.DataType) -> str:
    """The vocabulary name of a Spark type."""
    if isinstance(dtype, T.DecimalType):
        return "HUGEINT" if (dtype.precision, dtype.scale) == (38, 0) else "DECIMAL"
    return _FROM_SPARK.get(type(dtype), "VARCHAR")


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def describe(schema: T.StructType) -> list[tuple[str, str]]:
    """``[(column, vocabulary type)]`` of a schema."""
    return [(f.name, type_name(f.dataType)) for f in schema.fields]


def as_text(column: Column, dtype: T.DataType) -> Column:
    """Nested values as JSON, everything else outside the vocabulary as its string form."""
    if isinstance(dtype, T.StringType):
        return column
    return F.to_json(column) if is_nested(dtype) else column.cast("string")


def normalize_frame(df: DataFrame) -> DataFrame:
    """Turn every column whose type is outside the vocabulary into text."""
    odd = {
        f.name: as_text(col(f.name), f.dataType)
        for f in df.schema.fields
        if type_name(f.dataType) == "VARCHAR" and not isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(odd) if odd else df


@dataclass(frozen=True)
class SchemaDiff:
    """How an incoming schema differs from the registered one."""

    added: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    type_changes: tuple[tuple[str, str, str], ...] = ()

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.type_changes)


def schema_diff(registered: T.StructType, incoming: T.StructType) -> SchemaDiff:
    """Compare by column name and type class, so INTEGER and BIGINT are no drift."""
    old, new = dict(describe(registered)), dict(describe(incoming))
    return SchemaDiff(
        added=tuple(name for name in new if name not in old),
        removed=tuple(name for name in old if name not in new),
        type_changes=tuple(
            (name, old[name], kind)
            for name, kind in new.items()
            if name in old and TYPE_CLASS[old[name]] is not TYPE_CLASS[kind]
        ),
    )


def shared_columns(schemas: dict[str, T.StructType], column: str) -> dict[str, list[str]]:
    """Tables grouped by the type they give to ``column``."""
    by_type: dict[str, list[str]] = {}
    for table, schema in schemas.items():
        for name, kind in describe(schema):
            if name.lower() == column.lower():
                by_type.setdefault(kind, []).append(table)
    return by_type
