"""Conversions between the vocabulary types that never fail: a bad value becomes NULL.

``migration_cast`` also cleans formatted numbers; ``plain_cast`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.naming import col, field_of
from tablewright.types import MIGRATION_TYPES, as_text, spark_type

# Characters removed from a formatted number (white space, digit groups, currency,
# percent and accounting signs).
NUMBER_NOISE = " \t\n\f\r,$%€£¥()"

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = (
    rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
    r"|^(?i:[+-]?(?:inf|infinity|nan))$"
)
_PARENTHESIZED = r"(?d)^ *\(.*\) *\z"
# Groups: year, separator, month, day, clock. Anything behind the clock but a zone is refused.
_MOMENT = (
    r"^\s*0*(\d{2,4})([-/ \\])(\d{1,2})\2(\d{1,2})"
    r"(?:[ T]\s*(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)\s*(?:Z|UTC|[+-]\d{2}(?::?\d{2})?)?\s*%s)$"
)
_DATE = _MOMENT % r"|\s*"
_TIMESTAMP = (_MOMENT % "").removesuffix(")$") + ")?$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*_INTEGRAL, *_FRACTIONAL, T.DecimalType))


# The expressions below name their input as few times as possible: a filter evaluates every mention.


def text_to_double(text: Column, noise: str = "") -> Column:
    """Strict number parsing without the ``noise`` characters: no ``1d`` suffix, ``_`` only
    between digits."""
    clean = F.translate(text, noise, "") if noise else text
    return F.when(clean.rlike(_NUMBER), F.translate(text, noise + "_", "").try_cast("double"))


def double_to(number: Column, target: T.DataType) -> Column:
    """Round half to even for integer targets; out of range becomes NULL."""
    if isinstance(target, _INTEGRAL):
        return F.rint(number).try_cast(target)
    return number.try_cast(target)


def formatted_number(text: Column, target: T.DataType) -> Column:
    """Read ``$1,234.50``, ``12.5%`` and ``(2,500)`` as numbers."""
    sign = F.when(text.rlike(_PARENTHESIZED), -1).otherwise(1)
    scale = F.when(text.contains("%"), 0.01).otherwise(1.0)
    bare = text_to_double(text, NUMBER_NOISE)
    return double_to(bare * sign * scale, target)


def text_to_boolean(text: Column) -> Column:
    return F.when(F.trim(text) == text, text.try_cast("boolean"))


def text_to_date(text: Column) -> Column:
    """A full ``y-m-d`` date (also with ``/``), with or without a valid time behind it."""
    return _moment(text, _DATE).cast("date")


def text_to_timestamp(text: Column) -> Column:
    return _moment(text, _TIMESTAMP)


def _moment(text: Column, pattern: str) -> Column:
    """Rewrite an accepted spelling as ``y-m-d clock`` and cast that. Years have two to four
    digits; leading zeros give short ones the four a cast asks for."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "00$1-$3-$4 $5").try_cast("timestamp_ntz"))


def number_text(number: Column) -> Column:
    """A double as text: plain digits from 1e-4 up to 1e16, ``1e+20`` form outside."""
    raw = number.cast("string")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    digits = F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), digits)
    plain = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(number)
    return (
        F.when(F.isnan(number), "nan")
        .when(number == float("inf"), "inf")
        .when(number == float("-inf"), "-inf")
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def to_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DoubleType):
        return number_text(column)
    if isinstance(dtype, T.FloatType):
        return number_text(column.cast("string").cast("double"))
    if isinstance(dtype, T.TimestampNTZType):
        return F.when(column.isNotNull(), F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), _fraction(column)))
    return as_text(column, dtype)


def _fraction(column: Column) -> Column:
    tail = F.regexp_extract(column.cast("string"), r"(\.\d+)$", 1)
    return tail


def plain_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """A cast that yields NULL for values the target cannot hold."""
    if source == target:
        return column
    if isinstance(target, T.StringType):
        return to_text(column, source)
    if isinstance(source, T.StringType):
        if isinstance(target, T.BooleanType):
            return text_to_boolean(column)
        if isinstance(target, T.DateType):
            return text_to_date(column)
        if isinstance(target, T.TimestampNTZType):
            return text_to_timestamp(column)
        if isinstance(target, T.TimestampType):
            return text_to_timestamp(column).cast(target)
        if isinstance(target, T.DecimalType):
            return F.trim(column).try_cast(target)
        text = F.trim(column)
        if isinstance(target, _INTEGRAL):
            # Whole numbers stay exact; only a fraction goes through a double, rounded away from 0.
            return F.coalesce(text.try_cast(target), F.round(text_to_double(text)).try_cast(target))
        return double_to(text_to_double(text), target)
    if _is_number(source) or isinstance(source, T.BooleanType):
        if isinstance(source, _FRACTIONAL) and isinstance(target, _INTEGRAL):
            return double_to(column, target)
        if isinstance(source, T.DecimalType) and isinstance(target, _INTEGRAL):
            return F.round(column, 0).try_cast(target)
        if _is_number(target) or isinstance(target, T.BooleanType):
            return column.try_cast(target)
    instants = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(source, instants) and isinstance(target, instants):
        return column.try_cast(target)
    return F.lit(None).cast(target)


def migration_cast(column: Column, source: T.DataType, new_type: str) -> Column:
    """The cast used by column migration: numbers are cleaned of formatting first."""
    target = spark_type(new_type)
    if new_type.upper() not in ("INTEGER", "BIGINT", "DOUBLE"):
        return plain_cast(column, source, target)
    if isinstance(source, _INTEGRAL) or isinstance(source, _FRACTIONAL):
        return plain_cast(column, source, target)
    return formatted_number(to_text(column, source), target)


def check_migration_type(new_type: str) -> str:
    """The upper-cased target, or ValueError naming the accepted ones."""
    target = (new_type or "").upper()
    if target not in MIGRATION_TYPES:
        raise ValueError(f"cannot migrate to {new_type!r}; accepted: {', '.join(MIGRATION_TYPES)}")
    return target


def cast_of(df: DataFrame, column: str, new_type: str) -> Column:
    """Migration cast of a named column."""
    field = field_of(df, column)
    return migration_cast(col(field.name), field.dataType, check_migration_type(new_type))


def uncastable(df: DataFrame, column: str, new_type: str) -> Column:
    """True where a value is present and cannot be converted."""
    field = field_of(df, column)
    return cast_of(df, column, new_type).isNull() & col(field.name).isNotNull()


def cast_column(df: DataFrame, column: str, new_type: str) -> DataFrame:
    """The table with one column converted; uncastable values become NULL."""
    return df.withColumn(field_of(df, column).name, cast_of(df, column, new_type))


def castability(df: DataFrame, column: str, new_type: str) -> DataFrame:
    """One row ``castable, uncastable``; NULLs count as castable. One pass, one column read."""
    bad = F.count_if(uncastable(df, column, new_type))
    return df.agg((F.count(F.lit(1)) - bad).alias("castable"), bad.alias("uncastable"))


def nullified_keys(df: DataFrame, key: str, column: str, new_type: str) -> DataFrame:
    """``pk, column`` of every row whose value would be lost by the conversion."""
    field = field_of(df, key)
    name = field_of(df, column).name
    return df.filter(uncastable(df, column, new_type)).select(
        to_text(col(field.name), field.dataType).alias("pk"), F.lit(name).alias("column")
    )
