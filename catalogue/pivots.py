"""Pivots."""

from catalogue.registry import query
from tablewright import Pivot


# The values are listed, so that each statement can be stored as a view.
def flags(using, source="lineitem"):
    return f"SELECT * FROM (PIVOT {source} ON l_linestatus IN ('F', 'O') USING {using} GROUP BY l_suppkey, l_returnflag)"


for how in ("sum", "avg", "min", "max"):
    value = "l_quantity" if how in ("sum", "avg") else "l_extendedprice"

    def run(t, how=how, value=value):
        return Pivot("l_linestatus", {value: (how,)}, ("l_suppkey", "l_returnflag")).apply(t("lineitem"))

    query(f"pivot_{how}", flags(f"{how}({value})"))(run)

SPARSE = ("l_suppkey", "l_partkey", "l_linestatus", "nullif(l_tax, 0.02) AS tax")


@query(
    "pivot_count",
    f"""SELECT * FROM (PIVOT (SELECT {', '.join(SPARSE)} FROM lineitem) ON l_linestatus IN ('F', 'O') USING count(tax)
        GROUP BY l_partkey)""",
)
def _(t):
    return Pivot("l_linestatus", {"tax": ("count",)}, ("l_partkey",)).apply(t("lineitem", *SPARSE))


@query("pivot_default_sum", flags("sum(l_quantity)"))
def _(t):
    return Pivot("l_linestatus", {"l_quantity": ()}, ("l_suppkey", "l_returnflag")).apply(t("lineitem"))


@query(
    "pivot_multi",
    """SELECT * FROM (PIVOT lineitem ON l_returnflag IN ('A', 'N', 'R')
         USING sum(l_quantity), count(l_quantity), max(l_extendedprice) GROUP BY l_suppkey)""",
)
def _(t):
    values = {"l_quantity": ("sum", "count"), "l_extendedprice": ("max",)}
    return Pivot("l_returnflag", values, ("l_suppkey",)).apply(t("lineitem"))


@query(
    "pivot_repeated",
    """SELECT * FROM (PIVOT orders ON o_orderstatus IN ('F', 'O', 'P') USING max(o_totalprice), max(o_totalprice)
         GROUP BY o_orderpriority)""",
)
def _(t):
    values = [("o_totalprice", ("max",)), ("o_totalprice", ("max",))]
    return Pivot("o_orderstatus", values, ("o_orderpriority",)).apply(t("orders"))


NARROW = ("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")


@query(
    "pivot_no_index",
    f"SELECT * FROM (PIVOT (SELECT {', '.join(NARROW)} FROM lineitem) ON l_linestatus IN ('F', 'O') USING sum(l_quantity))",
)
def _(t):
    return Pivot("l_linestatus", {"l_quantity": ("sum",)}).apply(t("lineitem", *NARROW))


NULL_KEY = ("l_suppkey", "nullif(l_returnflag, 'R') AS flag", "l_quantity")


@query(
    "pivot_null_key",
    f"""SELECT * FROM (PIVOT (SELECT {', '.join(NULL_KEY)} FROM lineitem) ON flag IN ('A', 'N')
        USING sum(l_quantity), count(l_quantity) GROUP BY l_suppkey)""",
)
def _(t):
    return Pivot("flag", {"l_quantity": ("sum", "count")}, ("l_suppkey",)).apply(t("lineitem", *NULL_KEY))


DAYS = ("user_id", "event_type", "CAST(ts AS DATE) AS day")


@query(
    "pivot_dates",
    f"""WITH days AS (SELECT {', '.join(DAYS)} FROM events)
        SELECT u.user_id, CAST(d.day AS VARCHAR) AS day, count(e.event_type) AS n
        FROM (SELECT DISTINCT user_id FROM days) u CROSS JOIN (SELECT DISTINCT day FROM days) d
        LEFT JOIN days e ON e.user_id = u.user_id AND e.day = d.day
        GROUP BY u.user_id, d.day""",
)
def _(t):
    # One row per cell, since the days are not known when the statement is written.
    wide = Pivot("day", {"event_type": ("count",)}, ("user_id",)).apply(t("events", *DAYS))
    return wide.unpivot("user_id", wide.columns[1:], "day", "n")
