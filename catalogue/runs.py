"""Validations and runs."""

from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright import (
    ColumnFunction,
    DateCondition,
    DateRange,
    Filter,
    FunctionSet,
    FunctionStep,
    Join,
    Rename,
    RowFunction,
    SqlFunction,
    ValueFunction,
    Workspace,
    cols,
    compose,
    failing_rows_across,
    results_report,
    run_set_across,
    validate_across,
)
from tablewright.naming import BUNDLE_SEPARATOR, short_id_column
from tablewright.plans.report import totals

positive = ColumnFunction(name="positive", params={"x": "column"}, kind="validation", fn=lambda x: x > 0)
ordered = ColumnFunction(
    name="ordered", params={"a": "column", "b": "column"}, kind="validation", fn=lambda a, b: a <= b
)
at_least = ColumnFunction(
    name="at_least",
    params={"x": "column", "least": "float"},
    defaults={"least": "10"},
    kind="validation",
    fn=lambda x, least: x >= least,
)
not_empty = ValueFunction(name="not_empty", kind="validation", fn=lambda: F.count(F.lit(1)) > 0)
mean_below = ValueFunction(
    name="mean_below", params={"most": "float"}, kind="validation", fn=lambda most: F.avg("l_quantity") < most
)
doubled = ColumnFunction(name="doubled", params={"x": "column"}, fn=lambda x: x * 2)

KEYED = "left(sha1(from_hex('1f0960df5e2d5d8cb34bd677bff4e791') || encode({})), 8)"


def id_sql(function: str, bundle: str, table: str) -> str:
    parts = " || chr(31) || ".join(f"'{p}'" for p in bundle.split(BUNDLE_SEPARATOR))
    return KEYED.format(f"'{function}|' || {parts} || '|{table}'")


def counts_sql(table, function, bundle, predicate, source=None) -> str:
    """Passed and failed rows of one validation, as one row."""
    good = f"count(*) FILTER (WHERE coalesce({predicate}, false))"
    return f"""SELECT {id_sql(function, bundle, table)} AS result_id, {good} AS rows_passed,
        count(*) - {good} AS rows_failed, {good} / count(*) AS pass_rate FROM {source or table}"""


def lines(t, *steps) -> Workspace:
    return Workspace(t.spark).add("lineitem", t("lineitem"), steps)


def counts(run):
    return run.results().select("result_id", "rows_passed", "rows_failed", "pass_rate")


@query("validate_counts", counts_sql("lineitem", "positive", "l_discount", "l_discount > 0"))
def _(t):
    return counts(compose(lines(t, FunctionStep(positive, {"x": cols("l_discount")})), "lineitem", "validations"))


@query(
    "validate_bundles",
    " UNION ALL ".join(
        counts_sql("lineitem", "at_least", c, f"{c} >= 10") for c in ("l_quantity", "l_suppkey", "l_linenumber")
    ),
)
def _(t):
    step = FunctionStep(at_least, {"x": cols("l_quantity", "l_suppkey", "l_linenumber")})
    return counts(compose(lines(t, step), "lineitem", "validations"))


@query(
    "validate_pairs",
    " UNION ALL ".join(
        counts_sql("lineitem", "ordered", f"{a}{BUNDLE_SEPARATOR}{b}", f"{a} <= {b}")
        for a, b in (("l_linenumber", "l_quantity"), ("l_suppkey", "l_partkey"))
    ),
)
def _(t):
    step = FunctionStep(ordered, {"a": cols("l_linenumber", "l_suppkey"), "b": cols("l_quantity", "l_partkey")})
    return counts(compose(lines(t, step), "lineitem", "validations"))


@query(
    "validate_table",
    f"""SELECT {id_sql('not_empty', '', 'lineitem')} AS result_id, CAST(1 AS BIGINT) AS rows_passed,
            CAST(0 AS BIGINT) AS rows_failed, CAST(1 AS DOUBLE) AS pass_rate
        FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0
        UNION ALL
        SELECT {id_sql('mean_below', '', 'lineitem')}, CAST(m < 20 AS INTEGER), CAST(m >= 20 AS INTEGER),
               CAST(m < 20 AS INTEGER) / 1 FROM (SELECT avg(l_quantity) AS m FROM lineitem)""",
)
def _(t):
    steps = (FunctionStep(not_empty), FunctionStep(mean_below, {"most": 20}))
    return counts(compose(lines(t, *steps), "lineitem", "validations"))


@query("validate_row_function", counts_sql("lineitem", "odd", "l_linenumber", "l_linenumber % 2 = 1"))
def _(t):
    def odd(v):
        return v is not None and int(v) % 2 == 1

    fn = RowFunction(name="odd", params={"v": "int"}, kind="validation", fn=odd, returns="boolean")
    return counts(compose(lines(t, FunctionStep(fn, {"v": cols("l_linenumber")})), "lineitem", "validations"))


@query("validate_sql", counts_sql("lineitem", "in_range", "l_tax", "l_tax BETWEEN 0.01 AND 0.05"))
def _(t):
    fn = SqlFunction(
        name="in_range",
        params={"x": "column", "low": "float", "high": "float"},
        kind="validation",
        text="IDENTIFIER(:x) BETWEEN CAST(:low AS DOUBLE) AND :high",
    )
    step = FunctionStep(fn, {"x": cols("l_tax"), "low": "0.01", "high": "0.05"})
    return counts(compose(lines(t, step), "lineitem", "validations"))


GAPS = ("o_orderkey", "nullif(o_totalprice, o_totalprice * (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)) AS price")
GAPS_SQL = f"(SELECT {', '.join(GAPS)} FROM orders)"


@query("validate_null", counts_sql("orders", "at_least", "price", "price >= 100000", GAPS_SQL))
def _(t):
    step = FunctionStep(at_least, {"x": cols("price"), "least": "100000"})
    workspace = Workspace(t.spark).add("orders", t("orders", *GAPS), [step])
    return counts(compose(workspace, "orders", "validations"))


@query(
    "failing_rows",
    f"""SELECT {id_sql('positive', 'c_acctbal', 'customer')} AS result_id, CAST(c_custkey AS VARCHAR) AS key,
               CAST(to_json(customer) AS VARCHAR) AS row_json FROM customer WHERE NOT c_acctbal > 0
        UNION ALL
        SELECT {id_sql('at_least', 'c_nationkey', 'customer')}, CAST(c_custkey AS VARCHAR),
               CAST(to_json(customer) AS VARCHAR) FROM customer WHERE NOT c_nationkey >= 10""",
)
def _(t):
    steps = [
        FunctionStep(positive, {"x": cols("c_acctbal")}),
        FunctionStep(at_least, {"x": cols("c_nationkey")}),
        FunctionStep(not_empty),
    ]
    run = compose(Workspace(t.spark).add("customer", t("customer"), steps), "customer", "validations")
    return run.failing_rows("c_custkey")


@query("failing_rows_full", "SELECT * FROM lineitem WHERE NOT coalesce(l_quantity >= 10, false)")
def _(t):
    run = compose(lines(t, FunctionStep(at_least, {"x": cols("l_quantity")})), "lineitem", "validations")
    return run.failing(run.checks[0].result_id)


@query("validate_reads_raw", counts_sql("lineitem", "at_least", "l_quantity", "l_quantity >= 10"))
def _(t):
    """A filter before the validation does not change what it sees."""
    workspace = lines(t, Filter("l_quantity", "gte", "10"), FunctionStep(at_least, {"x": cols("l_quantity")}))
    run = compose(workspace, "lineitem", "all")
    return run.results().filter("function_type = 'validation'").select(
        "result_id", "rows_passed", "rows_failed", "pass_rate"
    )


def accounts(t) -> Workspace:
    """One set on three tables; one of the tables lacks the bound column."""

    def basics(*columns):
        return FunctionSet(
            "basics", [FunctionStep(positive, {"x": cols(*columns)}), FunctionStep(not_empty)]
        )

    return (
        Workspace(t.spark)
        .add("customer", t("customer"), [basics("c_acctbal", "c_nationkey")])
        .add("supplier", t("supplier"), [basics("s_acctbal")])
        .add("part", t("part"), [basics("no_such_column")])
        .add("nation", t("nation"), [Filter("n_regionkey", "gt", "1")])
    )


def across_sql(table: str, columns: tuple[str, ...]) -> str:
    good = " + ".join(f"count(*) FILTER (WHERE {c} > 0)" for c in columns)
    return f"""SELECT '{table}' AS source_name, 'positive' AS function_name, 'validation' AS function_type,
        '{table}' AS label, 'ok' AS status, {good} AS rows_passed, {len(columns)} * count(*) - ({good}) AS rows_failed,
        ({good}) / ({len(columns)} * count(*)) AS pass_rate, false AS has_error,
        {id_sql('positive', table, table)} AS result_id FROM {table}"""


@query(
    "cross_table_validation",
    f"""{across_sql('customer', ('c_acctbal', 'c_nationkey'))} UNION ALL {across_sql('supplier', ('s_acctbal',))}
        UNION ALL SELECT 'part', 'positive', 'validation', 'part', 'failed', NULL, NULL, NULL, true,
               {id_sql('positive', 'part', 'part')}""",
)
def _(t):
    result = validate_across(accounts(t), "positive")
    return result.withColumn("error", F.col("error").isNotNull()).withColumnRenamed("error", "has_error")


@query(
    "cross_table_failing_rows",
    f"""SELECT 'customer' AS source_name, {id_sql('positive', 'customer', 'customer')} AS result_id,
               CAST(c_custkey AS VARCHAR) AS key, CAST(to_json(customer) AS VARCHAR) AS row_json
        FROM customer WHERE NOT (c_acctbal > 0 AND c_nationkey > 0)
        UNION ALL
        SELECT 'supplier', {id_sql('positive', 'supplier', 'supplier')}, CAST(s_suppkey AS VARCHAR),
               CAST(to_json(supplier) AS VARCHAR) FROM supplier WHERE NOT s_acctbal > 0""",
)
def _(t):
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    return failing_rows_across(accounts(t), "positive", keys)


SET_COLUMNS = ("source_name", "function_name", "bundle_key", "status", "rows_passed", "rows_failed")


def set_sql(table: str, *columns: str) -> str:
    rows = [
        f"""SELECT '{table}' AS source_name, 'positive' AS function_name, '{c}' AS bundle_key, 'ok' AS status,
            count(*) FILTER (WHERE {c} > 0) AS rows_passed, count(*) FILTER (WHERE NOT {c} > 0) AS rows_failed
            FROM {table}"""
        for c in columns
    ]
    rows.append(
        f"""SELECT '{table}', 'not_empty', '', 'ok', CAST(count(*) > 0 AS INTEGER), CAST(count(*) = 0 AS INTEGER)
            FROM {table}"""
    )
    return " UNION ALL ".join(rows)


@query(
    "run_set_across_tables",
    f"""{set_sql('customer', 'c_acctbal', 'c_nationkey')} UNION ALL {set_sql('supplier', 's_acctbal')}
        UNION ALL {set_sql('part')}
        UNION ALL SELECT 'part', 'positive', 'no_such_column', 'failed', NULL, NULL""",
)
def _(t):
    return run_set_across(accounts(t), "basics").select(*SET_COLUMNS)


@query(
    "verdict_totals",
    """SELECT 'lineitem' AS source_name, 'at_least' AS function_name, a + b AS rows_passed, 2 * n - a - b AS rows_failed,
              (a + b) / (2 * n) AS pass_rate
       FROM (SELECT count(*) FILTER (WHERE l_quantity >= 10) AS a, count(*) FILTER (WHERE l_suppkey >= 10) AS b,
                    count(*) AS n FROM lineitem)""",
)
def _(t):
    step = FunctionStep(at_least, {"x": cols("l_quantity", "l_suppkey")})
    return totals(compose(lines(t, step), "lineitem", "validations").results())


def pipeline(t) -> Workspace:
    """Every kind of step. The rename and the date range are listed first and still run last."""
    steps = [
        Rename({"l_quantity": "quantity", "o_totalprice": "total"}),
        DateRange([[DateCondition("l_shipdate", "1996-01-01", "1998-12-31")]]),
        Filter("l_quantity", "gte", "25"),
        FunctionSet(
            "checks",
            [FunctionStep(at_least, {"x": cols("l_quantity")}), FunctionStep(doubled, {"x": cols("l_tax")})],
        ),
        FunctionStep(doubled, {"x": cols("no_such_column")}),
        Join("orders", [("l_orderkey", "o_orderkey")]),
    ]
    return Workspace(t.spark).add("lineitem", t("lineitem"), steps).add("orders", t("orders"))


CHAIN = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate, l_tax * 2 AS doubled_l_tax, o_orderkey, o_custkey, o_orderstatus,
    o_totalprice AS total, o_orderdate, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_quantity >= 25 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"""


@query("flagship", CHAIN)
def flagship(t):
    return compose(pipeline(t), "lineitem", "transforms").frame


RUN_ALL = f"""
    WITH big AS (SELECT * FROM lineitem WHERE l_quantity >= 25),
         j AS (SELECT l_shipdate FROM big JOIN orders ON l_orderkey = o_orderkey),
         d AS (SELECT * FROM j WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')
    SELECT 0 AS step_no, 'filter' AS function_name, 'transform' AS function_type, 'filter:2' AS bundle_key,
           'ok' AS status, (SELECT count(*) FROM big) AS rows_affected, NULL AS rows_passed, NULL AS rows_failed,
           {id_sql('filter', 'filter:2', 'lineitem')} AS result_id
    UNION ALL SELECT 1, 'at_least', 'validation', 'l_quantity', 'ok', NULL,
           (SELECT count(*) FROM lineitem WHERE l_quantity >= 10), (SELECT count(*) FROM lineitem WHERE l_quantity < 10),
           {id_sql('at_least', 'l_quantity', 'lineitem')}
    UNION ALL SELECT 2, 'doubled', 'transform', 'l_tax', 'ok', (SELECT count(*) FROM big), NULL, NULL,
           {id_sql('doubled', 'l_tax', 'lineitem')}
    UNION ALL SELECT 3, 'doubled', 'transform', 'no_such_column', 'failed', NULL, NULL, NULL,
           {id_sql('doubled', 'no_such_column', 'lineitem')}
    UNION ALL SELECT 4, 'join', 'transform', 'join:5', 'ok', (SELECT count(*) FROM j), NULL, NULL,
           {id_sql('join', 'join:5', 'lineitem')}
    UNION ALL SELECT 5, 'date_range', 'transform', 'date_range:1', 'ok', (SELECT count(*) FROM d), NULL, NULL,
           {id_sql('date_range', 'date_range:1', 'lineitem')}
    UNION ALL SELECT 6, 'rename', 'transform', 'rename:0', 'ok', (SELECT count(*) FROM d), NULL, NULL,
           {id_sql('rename', 'rename:0', 'lineitem')}"""
RUN_COLUMNS = (
    "step_no", "function_name", "function_type", "bundle_key", "status", "rows_affected", "rows_passed",
    "rows_failed", "result_id",
)


@query("run_all", RUN_ALL)
def _(t):
    return compose(pipeline(t), "lineitem", "all").results().select(*RUN_COLUMNS)


@query(
    "run_set",
    f"""SELECT 0 AS step_no, 'at_least' AS function_name, 'validation' AS function_type, 'l_quantity' AS bundle_key,
               'ok' AS status, NULL AS rows_affected, count(*) FILTER (WHERE l_quantity >= 10) AS rows_passed,
               count(*) FILTER (WHERE l_quantity < 10) AS rows_failed,
               {id_sql('at_least', 'l_quantity', 'lineitem')} AS result_id FROM lineitem
        UNION ALL SELECT 1, 'doubled', 'transform', 'l_tax', 'ok', count(*), NULL, NULL,
               {id_sql('doubled', 'l_tax', 'lineitem')} FROM lineitem""",
)
def _(t):
    return compose(pipeline(t), "lineitem", "set", "checks").results().select(*RUN_COLUMNS)


@query(
    "results_report",
    f"""SELECT function_name, function_type, 'lineitem' AS source_name, status, rows_passed, rows_failed,
               rows_passed / (rows_passed + rows_failed) AS pass_rate, status = 'failed' AS has_error, result_id
        FROM ({RUN_ALL})""",
)
def _(t):
    report = results_report(compose(pipeline(t), "lineitem", "all").results())
    return report.withColumn("error", F.col("error").isNotNull()).withColumnRenamed("error", "has_error")


@query(
    "result_ids",
    f"""SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id,
               {KEYED.format("'seen|' || event_type || '|' || CAST(user_id AS VARCHAR)")} AS result_id FROM events""",
)
def _(t):
    pairs = t("events", "event_type", "CAST(user_id AS STRING) AS user_id").distinct()
    return pairs.withColumn("result_id", short_id_column(F.lit("seen"), F.col("event_type"), F.col("user_id")))
