"""CSV reading, and grouping of files by the digits in their names."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PlanError
from tablewright.naming import col
from tablewright.sources.folder import Folder

# Names of the columns that keep the order of rows in their files.
ORDER_COLUMNS = ("__file", "__block", "__row")


# Quotes inside quoted fields are doubled, and a time alone is text.
_CSV = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd[ ]['T']HH:mm[:ss][.SSSSSS]"}


def csv_options(multi_line: bool = False) -> dict:
    """How files are read, in a batch or a stream: a row with too few or too many fields, a value of another
    type, or a header that isn't the schema's is an error, never a NULL or a value in the wrong column."""
    return {**_CSV, "multiLine": multi_line, "mode": "FAILFAST", "enforceSchema": False}


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool = False,
    order: bool = False,
) -> DataFrame:
    """Header CSV as vocabulary types: those of ``schema``, or the narrowest that hold every value, which one
    aggregate over the text finds.

    Columns are found by the names in each file's own header, so files may list them in different orders;
    all must have the same columns. ``multi_line`` allows line breaks inside quotes. Such a file cannot be
    split, so each is read by one task. ``order`` adds the position of each row, see ``with_file_order``.
    """
    if schema is None:
        text = read_text(spark, paths, multi_line, order)
        fields = [n for n in text.columns if n not in ORDER_COLUMNS]
        return as_types(text, narrowest_types(text.select([col(n) for n in fields])))
    frames = []
    for header, files in _alike(spark, paths).items():
        known = {f.name: f for f in schema.fields}
        if set(header) != set(known):
            raise PlanError(f"the header {list(header)} does not have the columns {list(known)}")
        frames.append(_rows(spark, T.StructType([known[h] for h in header]), files, multi_line))
    return reduce(DataFrame.unionByName, [with_file_order(f) for f in frames] if order else frames)


def read_text(spark: SparkSession, paths: str | list[str], multi_line: bool = False, order: bool = False) -> DataFrame:
    """Header CSV with every field as text, for one pass over the input; see ``narrowest_types``."""
    groups = _alike(spark, paths).items()
    frames = [_rows(spark, T.StructType([T.StructField(h, T.StringType()) for h in header]), files, multi_line) for header, files in groups]
    return reduce(DataFrame.unionByName, [with_file_order(f) for f in frames] if order else frames)


def _alike(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header; all must have the same columns."""
    groups = header_groups(spark, paths)
    names = {tuple(sorted(h)) for h in groups}
    if len(names) > 1:
        raise PlanError(f"the files have different columns: {sorted(names)}")
    return groups


def _rows(spark: SparkSession, schema: T.StructType, files: list[str], multi_line: bool) -> DataFrame:
    return spark.read.options(**csv_options(multi_line)).schema(schema).csv(files)


_WHOLE, _NUMBER = r"^[+-]?0*\d{1,%d}$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = ("NaN", "Inf", "-Inf", "Infinity", "-Infinity")
_DAY, _LONG, _LONGEST = r"^\d{4}-\d{2}-\d{2}$", 19, 38
# A refusal is an exception inside a cast or a parser, so texts that are longer than a type's numbers, or aren't
# like this, which whatever the timestamp format reads is, never get there.
_MOMENT = r"^[+-]?\d{4,}-\d{2}-\d{2} ?[Tt]?\d{2}:\d{2}[\d:.]*$"


def _readings(text: Column) -> list[tuple[T.DataType, Column]]:
    """What a text can be read as, the narrowest type first; NULL where it can't."""
    whole = lambda digits: F.when(text.rlike(_WHOLE % digits), text)
    number = F.when(text.rlike(_NUMBER), text).when(text.isin(*_SPECIAL), F.regexp_replace(text, "Inf$", "Infinity"))
    huge = T.DecimalType(_LONGEST, 0)
    return [
        (T.LongType(), whole(_LONG).try_cast("long")),
        (huge, whole(_LONGEST).try_cast(huge)),
        (T.DoubleType(), number.try_cast("double")),
        (T.DateType(), F.when(text.contains("-") & text.rlike(_DAY), text).try_cast("date")),
        (T.TimestampNTZType(), F.when(text.contains(":") & text.rlike(_MOMENT), F.try_to_timestamp(text, F.lit(_CSV["timestampFormat"]))).cast("timestamp_ntz")),
        (T.BooleanType(), F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")),
    ]


def narrowest_types(text: DataFrame) -> T.StructType:
    """The narrowest type that holds every value of each text column; text for a column without values.

    One aggregate counts, for every column, the values that each type can hold. Counts add up on the map
    side, so a task sends one row, whatever its share of the input; types of mixed columns follow from the
    same counts, and how the rows are dealt to tasks or files doesn't matter.
    """
    counts = []
    for i, name in enumerate(text.columns):
        counts.append(F.count(col(name)).alias(f"n{i}"))
        counts += [F.count(value).alias(f"n{i}_{k}") for k, (_, value) in enumerate(_readings(col(name)))]
    row = text.agg(*counts).first() if counts else {}
    fields = []
    for i, name in enumerate(text.columns):
        fitting = [kind for k, (kind, _) in enumerate(_readings(col(name))) if 0 < row[f"n{i}"] == row[f"n{i}_{k}"]]
        fields.append(T.StructField(name, fitting[0] if fitting else T.StringType()))
    return T.StructType(fields)


def as_types(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the types that ``narrowest_types`` found; other columns stay."""
    values = {f.name: dict(_readings(col(f.name))).get(f.dataType) for f in schema.fields}
    typed = {name: value for name, value in values.items() if value is not None}
    return text.withColumns(typed) if typed else text


def header_groups(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first line, in the order given. Folders and globs are expanded. Only
    the first line of a file is read, where the plan is made."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in Folder.files(spark, [paths] if isinstance(paths, str) else paths):
        header = tuple(next(csv.reader([Folder.first_line(spark, path).lstrip("\ufeff")]), []))
        groups.setdefault(header, []).append(path)
    if not groups:
        raise PlanError(f"no file at {paths!r}")
    return groups


def infer_schema(spark: SparkSession, paths: str | list[str]) -> T.StructType:
    return narrowest_types(read_text(spark, paths))


def with_file_block(df: DataFrame) -> DataFrame:
    """Add the file of each row and the block in the file; also for a stream of files."""
    position = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    return df.select("*", *[p.alias(n) for p, n in zip(position, ORDER_COLUMNS, strict=False)])


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the position of each row: file, block in the file, row in the block.

    Rows of one block share a task, in which the generated ids grow, so the three columns order
    rows as the files do however Spark packs blocks into tasks.
    """
    return with_file_block(df).select("*", F.monotonically_increasing_id().alias(ORDER_COLUMNS[2]))


def file_stem(path: Column) -> Column:
    """The file name without its folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def file_pattern(stem: Column) -> Column:
    """The stem with every run of digits generalized to ``\\d+``; NULL without digits."""
    return F.when(stem.rlike(r"\d"), F.regexp_replace(stem, r"\d+", r"\\d+"))


def name_pattern(spark: SparkSession, path: str) -> str | None:
    """:func:`file_pattern` of one file."""
    return spark.range(1).select(file_pattern(file_stem(F.lit(path)))).first()[0]


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """``path, length, stem, pattern`` of the files in a folder. Their content is not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stem = file_stem(F.col("path"))
    return listing.select("path", "length", stem.alias("stem"), file_pattern(stem).alias("pattern"))


def file_groups(listing: DataFrame) -> DataFrame:
    """``pattern, n_files, n_bytes`` per group of files named alike."""
    return listing.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").cast("long").alias("n_bytes")
    )


def match_tables(listing: DataFrame, patterns: Iterable[tuple[str, str | None]]) -> DataFrame:
    """Add ``table_name``: the first table whose pattern matches the whole stem.

    ``patterns`` are (table, pattern) in order of registration; invalid ones are passed over. A pattern that
    only generalizes digits matches the stems with that normal form, so such patterns are joined, however
    many tables there are. Hand-written ones are tried in turn.
    """
    plain: dict[str, tuple[int, str]] = {}
    written = F.lit(None).cast("struct<place: int, table_name: string>")
    for place, (table, pattern) in reversed(list(enumerate(patterns))):
        if pattern is None:
            continue
        if _PLAIN.fullmatch(pattern) and r"\d+\d+" not in pattern:
            plain[pattern] = (place, table)
            continue
        try:
            re.compile(pattern)
        except re.error:
            continue
        hit = F.struct(F.lit(place).alias("place"), F.lit(table).alias("table_name"))
        written = F.when(F.col("stem").rlike(f"^(?:{pattern})$"), hit).otherwise(written)
    spark = listing.sparkSession
    forms = spark.createDataFrame([(form, *hit) for form, hit in plain.items()], "__form string, __place int, __table string")
    joined = listing.withColumn("__form", F.coalesce(file_pattern(F.col("stem")), F.col("stem"))).join(forms, "__form", "left")
    by_form = F.when(F.col("__place").isNotNull(), F.struct(F.col("__place").alias("place"), F.col("__table").alias("table_name")))
    first = F.least(by_form, written).getField("table_name")
    return joined.select(*[col(c) for c in listing.columns], first.alias("table_name"))


# A pattern that means its own letters and runs of digits, and nothing else.
_PLAIN = re.compile(r"(?:[A-Za-z_ -]|\\d\+)+")
