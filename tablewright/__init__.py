"""Table pipelines and data quality as Spark DataFrame operators."""

from tablewright.functions.binding import cols
from tablewright.functions.user import (
    ChunkFunction,
    ColumnFunction,
    RowFunction,
    SeriesFunction,
    SqlFunction,
    TableFunction,
    ValueFunction,
)
from tablewright.operators.columns import Rename
from tablewright.operators.filters import DateCondition, DateRange, Filter
from tablewright.operators.joins import Join
from tablewright.operators.pivot import Pivot
from tablewright.plans.across import failing_rows_across, run_set_across, validate_across
from tablewright.plans.report import results_report
from tablewright.plans.run import compose
from tablewright.plans.steps import FunctionSet, FunctionStep
from tablewright.plans.workspace import Workspace
from tablewright.sources.ingest import ingest_csv, ingest_frame, ingest_group
from tablewright.sources.migrate import migrate_column
from tablewright.sources.store import TableSpec, TableStore

__all__ = [
    "ChunkFunction",
    "ColumnFunction",
    "DateCondition",
    "DateRange",
    "Filter",
    "FunctionSet",
    "FunctionStep",
    "Join",
    "Pivot",
    "Rename",
    "RowFunction",
    "SeriesFunction",
    "SqlFunction",
    "TableFunction",
    "TableSpec",
    "TableStore",
    "ValueFunction",
    "Workspace",
    "cols",
    "compose",
    "failing_rows_across",
    "ingest_csv",
    "ingest_frame",
    "ingest_group",
    "migrate_column",
    "results_report",
    "run_set_across",
    "validate_across",
]
