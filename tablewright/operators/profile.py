"""Row counts, key profiles and table summaries."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.naming import col, field_of
from tablewright.types import describe

# Fixed value: rows shown by a preview.
PREVIEW_ROWS = 200


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Some rows of a table, in no promised order."""
    return df.limit(rows)


def row_count(df: DataFrame) -> DataFrame:
    """One row ``n_rows``. On a stored table Parquet answers from its footers."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def key_profile(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """``n_rows, distinct_keys, has_duplicates``: rows exceed distinct keys when keys repeat.

    The exact distinct count dedups map-side before it shuffles; the sketch does not shuffle keys.
    """
    column = col(field_of(df, key).name)
    distinct = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("distinct_keys"))
    return counts.withColumn("has_duplicates", F.col("n_rows") > F.col("distinct_keys"))


def table_summary(name: str, df: DataFrame, registered: int = 0) -> DataFrame:
    """``table_name, registered_at, columns, n_rows`` of one table."""
    columns = ", ".join(f"{column} {kind}" for column, kind in describe(df.schema))
    return row_count(df).select(
        F.lit(name).alias("table_name"),
        F.lit(registered).cast("long").alias("registered_at"),
        F.lit(columns).alias("columns"),
        "n_rows",
    )


def table_summaries(tables: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """All summaries in one job, newest registration first, then by name."""
    parts = [table_summary(name, df, when) for name, (df, when) in tables.items()]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.orderBy(F.col("registered_at").desc(), "table_name")
