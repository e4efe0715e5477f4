"""Exports of transformed tables and result reports. All writing is done by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.naming import col
from tablewright.operators.casts import to_text
from tablewright.sources.store import TableStore


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL, as JSON cannot hold them."""
    fractional = {
        f.name: F.when(~F.isnan(col(f.name)) & (F.abs(col(f.name)) != float("inf")), col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fractional) if fractional else df


def row_json(df: DataFrame) -> Column:
    """A whole row as a JSON object; absent values are written as ``null``."""
    return F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})


def json_rows(df: DataFrame) -> DataFrame:
    """One ``row_json`` string per row of :func:`json_safe`."""
    safe = json_safe(df)
    return safe.select(row_json(safe).alias("row_json"))


# Quotes are doubled and spaces kept, so any CSV reader gets back what was written.
_CSV = {
    "header": True,
    "nullValue": "",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _write(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, NULL as an empty field."""
    text = [to_text(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    df.select(text).write.options(**_CSV).csv(path)


def export_snapshot_csv(store: TableStore, table: str, path: str) -> int | None:
    """Export the latest transformed output; None when the table was never run."""
    snapshots = store.snapshots(table)
    latest = snapshots.latest()
    if latest is None:
        return None
    df = snapshots.read(latest)
    _write(df, path)
    # A snapshot never changes, so its footers hold the number of rows written.
    return df.count()


def format_report(report: DataFrame) -> DataFrame:
    """The pass rate as ``12.3%``, empty where there is none."""
    percent = F.bround(F.col("pass_rate") * 100, 1)
    rate = F.when(F.col("pass_rate").isNotNull(), F.format_string("%.1f%%", percent))
    return report.withColumn("pass_rate", rate)


def write_report_csv(report: DataFrame, path: str) -> int:
    """Write a results report (one row per function and table) as one CSV file."""
    ordered = format_report(report).coalesce(1)
    _write(ordered, path)
    return report.sparkSession.read.options(header=True, escape='"', multiLine=True).csv(path).count()
