"""Renames and placement of computed columns; K5: JSON-safe values."""

from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright import ColumnFunction, FunctionStep, Rename, TableFunction, ValueFunction, cols
from tablewright.naming import label_column
from tablewright.operators.columns import broadcast_scalar
from tablewright.sources.export import json_rows, json_safe


def place(df, function, bind, **options):
    """Apply one function step to a table."""
    return FunctionStep(function, bind, **options).transform(df, df)[0]


doubled = ColumnFunction(name="doubled", params={"x": "column"}, fn=lambda x: x * 2)
added = ColumnFunction(name="added", params={"a": "column", "b": "column"}, fn=lambda a, b: a + b)


@query("rename_swap", "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")
def _(t):
    return Rename({"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey"}).apply(t("nation"))


@query(
    "rename_chain",
    """SELECT c_custkey AS c_name, c_name AS c_nationkey, c_nationkey AS nation_no, c_acctbal, c_mktsegment
       FROM customer""",
)
def _(t):
    return Rename({"c_custkey": "c_name", "c_name": "c_nationkey", "c_nationkey": "nation_no"}).apply(t("customer"))


@query("append_column", "SELECT *, l_quantity * 2 AS doubled_l_quantity FROM lineitem")
def _(t):
    return place(t("lineitem"), doubled, {"x": cols("l_quantity")})


@query(
    "append_bundles",
    """SELECT *, l_quantity + l_linenumber AS added_l_quantity, l_suppkey + l_linenumber AS added_l_suppkey,
              l_partkey + l_linenumber AS added_l_partkey
       FROM lineitem""",
)
def _(t):
    return place(t("lineitem"), added, {"a": cols("l_quantity", "l_suppkey", "l_partkey"), "b": cols("l_linenumber")})


@query(
    "append_collision",
    "SELECT *, l_quantity * 2 AS l_tax_2, l_linenumber * 2 AS l_tax_3 FROM lineitem",
)
def _(t):
    return place(t("lineitem"), doubled, {"x": cols("l_quantity", "l_linenumber")}, append_name="l_tax")


@query("replace_column", "SELECT * REPLACE (l_quantity * 2 AS l_quantity) FROM lineitem")
def _(t):
    return place(t("lineitem"), doubled, {"x": cols("l_quantity")}, output="replace")


@query(
    "replace_targets",
    """SELECT * REPLACE (l_partkey + l_linenumber AS l_suppkey, l_suppkey + l_linenumber AS l_partkey)
       FROM lineitem""",
)
def _(t):
    bind = {"a": cols("l_partkey", "l_suppkey"), "b": cols("l_linenumber")}
    return place(t("lineitem"), added, bind, output="replace", targets=("l_suppkey", "l_partkey"))


@query(
    "replace_table",
    "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    def per_flag(df):
        return df.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))

    return place(t("lineitem"), TableFunction(name="per_flag", fn=per_flag), {})


@query("broadcast_scalar", "SELECT *, (SELECT avg(l_quantity) FROM lineitem) AS mean_quantity FROM lineitem")
def _(t):
    return broadcast_scalar(t("lineitem"), "mean_quantity", F.avg("l_quantity"))


@query("broadcast_literal", "SELECT *, 7 AS batch_no FROM nation")
def _(t):
    seven = ValueFunction(name="batch_no", fn=lambda: F.max(F.lit(7)))
    return place(t("nation"), seven, {})


LABELS = "concat('__', p_brand, ' / ', p_name, '!')"


@query(
    "label_normalizer",
    f"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace({LABELS}, '[^0-9A-Za-z]+', '_', 'g'), '_'), ''),
               'result') AS label, 'result' AS empty_label FROM part""",
)
def _(t):
    label = label_column(F.expr(LABELS)).alias("label")
    return t("part").select("p_partkey", label, label_column(F.lit("--")).alias("empty_label"))


ODD_NUMBERS = """CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE)
    WHEN event_type = 'view' THEN CAST('Infinity' AS DOUBLE)
    WHEN event_type = 'click' THEN -CAST('Infinity' AS DOUBLE) ELSE value END AS value"""


@query(
    "json_safe_rows",
    f"""SELECT event_id, event_type, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value
        FROM (SELECT event_id, event_type, {ODD_NUMBERS} FROM events)""",
)
def _(t):
    return json_safe(t("events", "event_id", "event_type", ODD_NUMBERS))


@query("json_rows", "SELECT CAST(to_json(customer) AS VARCHAR) AS row_json FROM customer")
def _(t):
    return json_rows(t("customer"))
