"""Every operator as a query over the shared test tables, next to the SQL that must agree."""

from catalogue import columns, filters, functions, ingest, joins, migrations, ordered, pivots, profiles, runs  # noqa: F401
from catalogue.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
