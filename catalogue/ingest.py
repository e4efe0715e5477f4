"""Key semantics of an ingest, and file groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import query, scratch
from tablewright import TableSpec, TableStore, ingest_frame
from tablewright.operators import keys as K
from tablewright.sources.files import file_groups, file_pattern, match_tables

# The stored table holds the orders before 1999; the batch brings those since 1998 at new prices.
COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
BASE = "o_orderdate < '1999-01-01'"
BATCH = "o_orderdate >= '1998-01-01'"
BASE_SQL = f"(SELECT {', '.join(COLUMNS)}, o_totalprice FROM orders WHERE {BASE})"
BATCH_SQL = f"(SELECT {', '.join(COLUMNS)}, o_totalprice + 1 AS o_totalprice FROM orders WHERE {BATCH})"
ORDER = ["o_orderkey"]


def base(t):
    return t("orders").filter(BASE).select(*COLUMNS, "o_totalprice")


def batch(t):
    return t("orders").filter(BATCH).select(*COLUMNS, (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query(
    "key_check",
    """SELECT key, count(*) AS n_rows FROM (SELECT nullif(l_orderkey, 11) AS key FROM lineitem)
       GROUP BY key HAVING count(*) > 1 OR key IS NULL""",
)
def _(t):
    return K.key_violations(t("lineitem", "nullif(l_orderkey, 11) AS key"), "key")


@query(
    "ingest_append",
    f"SELECT * FROM {BASE_SQL} UNION ALL SELECT * FROM {BATCH_SQL} WHERE o_orderdate >= '1999-01-01'",
)
def _(t):
    return K.append(base(t), batch(t).filter("o_orderdate >= '1999-01-01'"))


@query(
    "ingest_append_conflict",
    f"""WITH b AS (SELECT nullif(o_orderkey, 20) AS k FROM {BATCH_SQL})
        SELECT CAST(k AS VARCHAR) AS key, count(*) AS n_rows, CASE WHEN k IS NULL THEN 'null' ELSE 'repeated' END AS reason
        FROM b GROUP BY k HAVING count(*) > 1 OR k IS NULL
        UNION ALL
        SELECT CAST(k AS VARCHAR), 1, 'exists' FROM (SELECT DISTINCT k FROM b)
        WHERE k IN (SELECT o_orderkey FROM {BASE_SQL})""",
)
def _(t):
    odd = batch(t).withColumn("o_orderkey", F.expr("nullif(o_orderkey, 20)"))
    return K.append_conflicts(base(t), odd, "o_orderkey")


@query(
    "ingest_upsert",
    f"""SELECT * FROM {BASE_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {BATCH_SQL})
        UNION ALL SELECT * FROM {BATCH_SQL}""",
)
def _(t):
    return K.upsert(base(t), batch(t), "o_orderkey", ORDER)


@query(
    "ingest_skip",
    f"""SELECT * FROM {BASE_SQL} UNION ALL
        SELECT * FROM {BATCH_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {BASE_SQL})""",
)
def _(t):
    return K.skip(base(t), batch(t), "o_orderkey", ORDER)


@query(
    "ingest_skip_keys",
    f"SELECT o_orderkey FROM {BATCH_SQL} WHERE o_orderkey IN (SELECT o_orderkey FROM {BASE_SQL})",
)
def _(t):
    return K.skipped_keys(base(t), batch(t), "o_orderkey")


def stored(t, method: str, rows) -> DataFrame:
    """The table after the base and a batch went through a store."""
    store = TableStore(t.spark, scratch(t.spark))
    store.register(TableSpec("orders", "o_orderkey", base(t).schema))
    for frame, how in ((base(t), "upsert"), (rows, method)):
        result = ingest_frame(store, "orders", frame, how)
        assert result.ok, result
    return store.read("orders")


@query(
    "stored_append",
    f"SELECT * FROM {BASE_SQL} UNION ALL SELECT * FROM {BATCH_SQL} WHERE o_orderdate >= '1999-01-01'",
)
def _(t):
    return stored(t, "append", batch(t).filter("o_orderdate >= '1999-01-01'"))


@query(
    "stored_upsert",
    f"""SELECT * FROM {BASE_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {BATCH_SQL})
        UNION ALL SELECT * FROM {BATCH_SQL}""",
)
def _(t):
    return stored(t, "upsert", batch(t))


@query(
    "stored_skip",
    f"""SELECT * FROM {BASE_SQL} UNION ALL
        SELECT * FROM {BATCH_SQL} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {BASE_SQL})""",
)
def _(t):
    return stored(t, "skip", batch(t))


LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "ingest_duplicates",
    f"""SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem)
        WHERE rn = 1""",
)
def _(t):
    return K.first_rows(t("lineitem"), "l_orderkey", list(LINE_ORDER))


# File names as a landing folder would hold them, one per line item.
FILE = """concat('/landing/', CASE l_returnflag WHEN 'R' THEN 'returns-' WHEN 'A' THEN 'sales_' ELSE 'export' END,
    CAST(l_orderkey AS STRING), CASE l_linestatus WHEN 'O' THEN '.2024.' ELSE '-v2.' END, 'csv')"""
STEM = f"regexp_replace(split_part({FILE}, '/', -1), '\\.[^.]*$', '')"


def listing(t):
    from tablewright.sources.files import file_stem

    files = t("lineitem", f"{FILE} AS path", "l_orderkey + l_suppkey AS length")
    return files.withColumn("stem", file_stem(F.col("path"))).withColumn("pattern", file_pattern(F.col("stem")))


@query(
    "file_patterns",
    f"""SELECT regexp_replace({STEM}, '[0-9]+', '\\\\d+', 'g') AS pattern, count(*) AS n_files,
               CAST(sum(l_orderkey + l_suppkey) AS BIGINT) AS n_bytes FROM lineitem GROUP BY 1""",
)
def _(t):
    return file_groups(listing(t))


@query(
    "file_match",
    f"""SELECT stem, CASE WHEN regexp_full_match(stem, 'returns-\\d+.*') THEN 'returns'
                          WHEN regexp_full_match(stem, 'sales_\\d+-v\\d+') THEN 'sales' END AS table_name
        FROM (SELECT {STEM} AS stem FROM lineitem)""",
)
def _(t):
    patterns = [("returns", r"returns-\d+.*"), ("broken", "(["), ("none", None), ("sales", r"sales_\d+-v\d+"),
                ("late", r"returns-\d+.*")]
    return match_tables(listing(t), patterns).select("stem", "table_name")
