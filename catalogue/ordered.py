"""Whole columns in order."""

from catalogue.registry import query, scratch
from tablewright.operators.ordered import running

LINES = ("l_orderkey", "l_linenumber", "l_shipdate", "CAST(l_extendedprice AS decimal(15,2)) AS price", "nullif(l_quantity, 7) AS quantity")
LINES_SQL = """(SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_extendedprice AS DECIMAL(15,2)) AS price,
                        nullif(l_quantity, 7) AS quantity FROM lineitem)"""
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "price", "quantity"]


def _lines(t):
    # Lines that are equal in all these columns would tie.
    return t("lineitem", *LINES).distinct()


@query(
    "running_totals",
    f"""SELECT *, sum(price) OVER w AS total, count(quantity) OVER w AS known, row_number() OVER w AS place
        FROM (SELECT DISTINCT * FROM {LINES_SQL})
        WINDOW w AS (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in ORDER)} ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    scans = {"total": ("running_sum", "price"), "known": ("running_count", "quantity"), "place": ("row_number", None)}
    return running(_lines(t), ORDER, scans, scratch(t.spark))


@query(
    "running_extremes",
    f"""SELECT *, min(price) OVER w AS lowest, max(quantity) OVER w AS highest, lag(quantity) OVER w AS before
        FROM (SELECT DISTINCT * FROM {LINES_SQL})
        WINDOW w AS (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in ORDER)} ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    scans = {"lowest": ("running_min", "price"), "highest": ("running_max", "quantity"), "before": ("previous", "quantity")}
    return running(_lines(t), ORDER, scans, scratch(t.spark))
