"""Joins to raw and transformed tables."""

from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright import Filter, FunctionSet, FunctionStep, Join, Rename, ValueFunction, Workspace, compose
from tablewright.plans.run import effective_columns

# Suppliers numbered 20 higher: some line items have no supplier, some suppliers no line items.
SHIFTED = ("s_suppkey + 20 AS supp_no", "s_name", "s_nationkey")
SHIFTED_SQL = f"(SELECT {', '.join(SHIFTED)} FROM supplier)"
LINES = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
LINES_SQL = f"(SELECT {', '.join(LINES)} FROM lineitem)"


@query("join_inner", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return Join(t("customer"), [("o_custkey", "c_custkey")]).apply(t("orders"))


def shifted_join(how, **options):
    return lambda t: Join(t("supplier", *SHIFTED), [("l_suppkey", "supp_no")], how, **options).apply(
        t("lineitem", *LINES)
    )


for how in ("left", "right", "full"):
    sql = f"SELECT * FROM {LINES_SQL} {how.upper()} JOIN {SHIFTED_SQL} ON l_suppkey = supp_no"
    query(f"join_{how}", sql)(shifted_join(how, skew="plain"))
    query(f"join_{how}_split", sql)(shifted_join(how, skew="split"))


@query(
    "join_composite",
    """SELECT * FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey""",
)
def _(t):
    return Join(t("customer"), [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")]).apply(t("supplier"))


NULL_CUSTOMER = "CASE WHEN o_orderpriority < '3' THEN NULL ELSE o_custkey END AS buyer"


@query(
    "join_null_keys",
    f"""SELECT * FROM (SELECT o_orderkey, {NULL_CUSTOMER} FROM orders)
        LEFT JOIN (SELECT nullif(c_custkey, 7) AS cust, c_name FROM customer) ON buyer = cust""",
)
def _(t):
    right = t("customer", "nullif(c_custkey, 7) AS cust", "c_name")
    return Join(right, [("buyer", "cust")], "left").apply(t("orders", "o_orderkey", NULL_CUSTOMER))


# Two of five orders belong to one buyer, and as many have none.
HOT_BUYER = """CASE WHEN o_orderpriority < '3' THEN 0 WHEN o_orderpriority > '4' THEN NULL
    ELSE o_custkey END AS buyer"""


@query(
    "join_hot_key",
    f"SELECT * FROM (SELECT o_orderkey, {HOT_BUYER} FROM orders) FULL JOIN customer ON buyer = c_custkey",
)
def _(t):
    return Join(t("customer"), [("buyer", "c_custkey")], "full", skew="split").apply(
        t("orders", "o_orderkey", HOT_BUYER)
    )


@query(
    "join_hot_right",
    f"SELECT * FROM customer LEFT JOIN (SELECT o_orderkey, {HOT_BUYER} FROM orders) ON c_custkey = buyer",
)
def _(t):
    return Join(t("orders", "o_orderkey", HOT_BUYER), [("c_custkey", "buyer")], "left", skew="split").apply(
        t("customer")
    )


@query(
    "join_dup_names",
    """SELECT l.id AS id, l.name AS name, l.id_1 AS id_1, r.id AS id_2, r.name AS name_1
       FROM (SELECT c_nationkey AS id, c_name AS name, c_custkey AS id_1 FROM customer) l
       JOIN (SELECT n_nationkey AS id, n_name AS name FROM nation) r ON l.id = r.id""",
)
def _(t):
    left = t("customer", "c_nationkey AS id", "c_name AS name", "c_custkey AS id_1")
    return Join(t("nation", "n_nationkey AS id", "n_name AS name"), [("id", "id")]).apply(left)


@query(
    "join_self",
    """SELECT l.n_nationkey AS n_nationkey, l.n_name AS n_name, l.n_regionkey AS n_regionkey,
              r.n_nationkey AS n_nationkey_1, r.n_name AS n_name_1, r.n_regionkey AS n_regionkey_1
       FROM nation l JOIN nation r ON l.n_regionkey = r.n_regionkey""",
)
def _(t):
    nation = t("nation")
    return Join(nation, [("n_regionkey", "n_regionkey")]).apply(nation)


@query("join_prune", "SELECT o.*, c_mktsegment FROM orders o JOIN customer ON o_custkey = c_custkey")
def _(t):
    return Join(t("customer"), [("o_custkey", "c_custkey")], keep_columns=("c_mktsegment",)).apply(t("orders"))


def shop(t) -> Workspace:
    """Line items that read the transformed orders, whose steps keep the finished ones."""
    finished = [Filter("o_orderstatus", "eq", "F"), Rename({"o_orderstatus": "state"})]
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = [Join("orders", [("l_orderkey", "o_orderkey")], "left", use_transformed=True)]
    raw = [Join("orders", [("l_orderkey", "o_orderkey")], "inner")]
    plain = [Join("supplier", [("l_suppkey", "s_suppkey")], use_transformed=True)]
    has_rows = ValueFunction(name="has_rows", kind="validation", fn=lambda: F.count(F.lit(1)) > 0)
    return (
        Workspace(t.spark)
        .add("orders", orders, finished)
        .add("supplier", t("supplier"), [FunctionSet("basics", [FunctionStep(has_rows)])])
        .add("lineitem", t("lineitem", *LINES), joined)
        .add("lineitem_raw", t("lineitem", *LINES), raw)
        .add("lineitem_plain", t("lineitem", *LINES), plain)
    )


@query(
    "join_transformed",
    f"""SELECT * FROM {LINES_SQL}
        LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderstatus AS state, o_totalprice FROM orders
                   WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""",
)
def _(t):
    return compose(shop(t), "lineitem", "transforms").frame


@query(
    "join_raw",
    f"""SELECT l.*, o_orderkey, o_custkey, o_orderstatus, o_totalprice
        FROM {LINES_SQL} l JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    return compose(shop(t), "lineitem_raw", "transforms").frame


@query("transformed_fallback", f"SELECT * FROM {LINES_SQL} JOIN supplier ON l_suppkey = s_suppkey")
def _(t):
    return compose(shop(t), "lineitem_plain", "transforms").frame


@query(
    "join_lineage",
    """SELECT 'join' AS function_name, 'ok' AS status, count(*) AS rows_affected,
              left(sha1(from_hex('1f0960df5e2d5d8cb34bd677bff4e791') || encode('supplier|transformed|0')), 8)
                  AS consumed_result_id
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def _(t):
    results = compose(shop(t), "lineitem_plain", "transforms").results()
    return results.select("function_name", "status", "rows_affected", "consumed_result_id")


@query(
    "effective_columns",
    """SELECT c.name AS column_name, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
         (VALUES ('l_orderkey'), ('l_linenumber'), ('l_suppkey'), ('l_quantity'), ('o_orderkey'), ('o_custkey'),
                 ('o_orderstatus'), ('o_totalprice')) c(name) GROUP BY 1""",
)
def _(t):
    workspace = shop(t)
    names = [name for name, _ in effective_columns(workspace, "lineitem_raw", position=1)]
    each = F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name")
    frame = compose(workspace, "lineitem_raw", "transforms").frame
    return frame.agg(F.count(F.lit(1)).alias("n_rows")).select(each, "n_rows")
