"""User functions."""

from pyspark.sql import functions as F

from catalogue.columns import place
from catalogue.registry import query
from tablewright import (
    ChunkFunction,
    ColumnFunction,
    RowFunction,
    SeriesFunction,
    SqlFunction,
    TableFunction,
    ValueFunction,
    Workspace,
    cols,
)
from tablewright.plans.steps import FunctionStep


@query(
    "row_function",
    """SELECT *, CASE WHEN flag IS NULL THEN NULL WHEN l_quantity >= 25 THEN flag || '-big'
                 ELSE flag || '-small' END AS size
       FROM (SELECT l_orderkey, l_quantity, nullif(l_returnflag, 'N') AS flag FROM lineitem)""",
)
def _(t):
    # Functions defined inside travel to the workers by value, without their module.
    def size_class(quantity, flag, limit):
        if flag is None:
            return None
        return f"{flag}-{'big' if quantity >= limit else 'small'}"

    fn = RowFunction(
        name="size_class",
        params={"quantity": "float", "flag": "str", "limit": "int"},
        defaults={"limit": "25"},
        fn=size_class,
    )
    df = t("lineitem", "l_orderkey", "l_quantity", "nullif(l_returnflag, 'N') AS flag")
    return place(df, fn, {"quantity": cols("l_quantity"), "flag": cols("flag")}, append_name="size")


@query("column_function", "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(t):
    fn = ColumnFunction(
        name="net", params={"price": "column", "discount": "column"}, fn=lambda price, discount: price * (1 - discount)
    )
    bind = {"price": cols("l_extendedprice"), "discount": cols("l_discount")}
    return place(t("lineitem"), fn, bind, append_name="net")


@query(
    "series_function",
    "SELECT *, greatest(l_quantity / 2, 5.0) AS halved_l_quantity FROM lineitem",
)
def _(t):
    def halved(x, floor):
        return (x / 2).clip(lower=floor)

    fn = SeriesFunction(
        name="halved", params={"x": "column", "floor": "float"}, fn=halved, returns="double", rowwise=True
    )
    return place(t("lineitem"), fn, {"x": cols("l_quantity"), "floor": 5})


@query(
    "centered_column",
    "SELECT *, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS centered FROM lineitem",
)
def _(t):
    """A whole-column statistic, as an aggregate and a native expression."""
    lines = t("lineitem")
    mean = ValueFunction(name="mean", fn=lambda: F.avg("l_quantity"))
    minus = ColumnFunction(name="minus", params={"a": "column", "b": "column"}, fn=lambda a, b: a - b)
    df = place(lines, mean, {})
    return place(df, minus, {"a": cols("l_quantity"), "b": cols("mean")}, append_name="centered").drop("mean")


@query(
    "table_function",
    """SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem
       GROUP BY l_orderkey HAVING count(*) >= 3""",
)
def _(t):
    def per_order(df, least):
        sums = df.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
        return sums.filter(F.col("n_lines") >= least)

    return place(t("lineitem"), TableFunction(name="per_order", params={"least": "int"}, fn=per_order), {"least": "3"})


@query("chunk_function", "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 10")
def _(t):
    def long_names(part):
        return part.loc[part["p_name"].str.len() > 10, ["p_partkey", "p_name"]]

    fn = ChunkFunction(name="long_names", fn=long_names, schema="p_partkey long, p_name string")
    return place(t("part"), fn, {})


@query("value_function", "SELECT *, (SELECT max(o_orderdate) FROM orders) AS latest FROM orders")
def _(t):
    return place(t("orders"), ValueFunction(name="latest", fn=lambda: F.max("o_orderdate")), {})


TEMPLATE = "SELECT *, IDENTIFIER(:amount) * 2 AS twice FROM {source_table} WHERE IDENTIFIER(:amount) > :least"


@query("sql_template", "SELECT *, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 30")
def _(t):
    fn = SqlFunction(
        name="big", params={"amount": "column", "least": "float"}, defaults={"least": "30"}, text=TEMPLATE
    )
    return place(t("lineitem"), fn, {"amount": cols("l_quantity")})


@query("sql_template_raw", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    """Without parameters the query reads the raw table, whatever the steps before it did."""
    raw = t("orders")
    working = raw.filter("o_orderstatus = 'F'")
    fn = SqlFunction(name="per_status", text="SELECT o_orderstatus, count(*) AS n FROM {source_table} GROUP BY 1")
    return FunctionStep(fn).transform(working, raw)[0]


@query("source_ref", "SELECT o.*, c_name FROM orders o JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def _(t):
    workspace = Workspace(t.spark).add("customer", t("customer"))
    fn = SqlFunction(
        name="rich",
        params={"people": "source", "least": "float"},
        text="SELECT s.*, c_name FROM {source_table} s JOIN {people} ON o_custkey = c_custkey WHERE c_acctbal > :least",
    )
    orders = t("orders")
    return FunctionStep(fn, {"people": "customer", "least": "5000"}).transform(orders, orders, workspace)[0]
