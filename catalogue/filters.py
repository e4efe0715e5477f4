"""Filters and date ranges."""

from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright import DateCondition, DateRange, Filter


@query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return Filter("o_orderstatus", "eq", "F").apply(t("orders"))


NULLED = "nullif(o_orderpriority, '1-URGENT') AS priority"


@query("filter_neq", f"SELECT * FROM (SELECT o_orderkey, {NULLED} FROM orders) WHERE priority != '5-LOW'")
def _(t):
    return Filter("priority", "neq", "5-LOW").apply(t("orders", "o_orderkey", NULLED))


@query("filter_gt", "SELECT * FROM lineitem WHERE l_quantity > 25")
def _(t):
    return Filter("l_quantity", "gt", "25").apply(t("lineitem"))


@query("filter_gte", "SELECT * FROM part WHERE p_size >= 20")
def _(t):
    return Filter("p_size", "gte", "20.0").apply(t("part"))


@query("filter_lt", "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-15'")
def _(t):
    return Filter("o_orderdate", "lt", "1998-03-15").apply(t("orders"))


@query("filter_lte", "SELECT * FROM customer WHERE c_acctbal <= '2500.5'")
def _(t):
    return Filter("c_acctbal", "lte", "2500.5").apply(t("customer"))


@query("filter_contains", "SELECT doc_id, lang, text FROM documents WHERE text LIKE '%an_ %'")
def _(t):
    return Filter("text", "contains", "an_ ").apply(t("documents", "doc_id", "lang", "text"))


@query("filter_contains_number", "SELECT * FROM lineitem WHERE CAST(l_extendedprice AS VARCHAR) LIKE '%5.0%'")
def _(t):
    return Filter("l_extendedprice", "contains", "5.0").apply(t("lineitem"))


@query(
    "filter_not_contains",
    "SELECT * FROM (SELECT p_partkey, nullif(p_type, 'PROMO') AS kind FROM part) WHERE kind NOT LIKE '%A%'",
)
def _(t):
    return Filter("kind", "not_contains", "A").apply(t("part", "p_partkey", "nullif(p_type, 'PROMO') AS kind"))


@query("filter_is_null", f"SELECT * FROM (SELECT o_orderkey, {NULLED} FROM orders) WHERE priority IS NULL")
def _(t):
    return Filter("priority", "is_null").apply(t("orders", "o_orderkey", NULLED))


@query("filter_is_not_null", f"SELECT * FROM (SELECT o_orderkey, {NULLED} FROM orders) WHERE priority IS NOT NULL")
def _(t):
    return Filter("priority", "is_not_null").apply(t("orders", "o_orderkey", NULLED))


@query(
    "date_in_range",
    "SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'",
)
def _(t):
    return DateRange([[DateCondition("ts", "2024-01-05", "2024-01-12")]]).apply(t("events"))


@query("date_on_or_after", "SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-07-01'")
def _(t):
    return DateRange([[DateCondition("o_orderdate", start="1999-07-01")]]).apply(t("orders"))


@query("date_on_or_before", "SELECT * FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1996-02-29'")
def _(t):
    return DateRange([[DateCondition("l_shipdate", end="1996-02-29")]]).apply(t("lineitem"))


TWO_DATES = (
    "l_orderkey",
    "l_linenumber",
    "nullif(l_shipdate, TIMESTAMP '1996-05-05 00:00:00') AS shipped",
    "o_orderdate",
)


@query(
    "date_range_dnf",
    f"""
    WITH d AS (SELECT {', '.join(TWO_DATES)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT * FROM d
    WHERE coalesce(CAST(shipped AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30', false)
            AND coalesce(CAST(o_orderdate AS DATE) <= DATE '1996-03-31', false)
       OR coalesce(CAST(o_orderdate AS DATE) >= DATE '2000-01-01', false)
    """,
)
def _(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    dated = joined.select(*[F.expr(e.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")) for e in TWO_DATES])
    first = [DateCondition("shipped", "1996-01-01", "1996-06-30"), DateCondition("o_orderdate", end="1996-03-31")]
    return DateRange([first, [DateCondition("o_orderdate", start="2000-01-01")]]).apply(dated)
