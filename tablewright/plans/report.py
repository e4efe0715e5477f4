"""The results report: one row per function and table, passed runs included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.verdicts import pass_rate

# The columns of a results report.
REPORT_COLUMNS = (
    "function_name",
    "function_type",
    "source_name",
    "status",
    "rows_passed",
    "rows_failed",
    "pass_rate",
    "error",
    "result_id",
)


def results_report(results: DataFrame) -> DataFrame:
    """Project the results of any kind of run onto the report, keeping their order."""
    order = [F.col(c) for c in ("source_name", "step_no") if c in results.columns]
    return results.orderBy(*order).select(*REPORT_COLUMNS)


def totals(results: DataFrame) -> DataFrame:
    """Counts summed per table and function, with the pass rate of the sums."""
    sums = (
        results.filter(F.col("function_type") == "validation")
        .groupBy("source_name", "function_name")
        .agg(F.sum("rows_passed").alias("rows_passed"), F.sum("rows_failed").alias("rows_failed"))
    )
    return sums.withColumn("pass_rate", pass_rate(F.col("rows_passed"), F.col("rows_failed")))
