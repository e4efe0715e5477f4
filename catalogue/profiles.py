"""Row counts, key profiles, table summaries."""

from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright.operators.profile import key_profile, preview, row_count, table_summaries

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def _(t):
    return row_count(t("lineitem"))


@query(
    "key_profile",
    """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS distinct_keys,
              count(*) > count(DISTINCT l_orderkey) AS has_duplicates FROM lineitem""",
)
def _(t):
    return key_profile(t("lineitem"), "l_orderkey")


@query(
    "key_profile_unique",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS distinct_keys,
              count(*) > count(DISTINCT o_orderkey) AS has_duplicates FROM orders""",
)
def _(t):
    return key_profile(t("orders"), "o_orderkey")


@query(
    "table_summaries",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES),
)
def _(t):
    return table_summaries({n: (t(n), i) for i, n in enumerate(NAMES)}).select("table_name", "n_rows")


# Which rows a preview shows is not defined, but how many there are and that the table has them all.
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("row_preview", "SELECT least(200, count(*)) AS n_rows, least(200, count(*)) AS n_found FROM lineitem")
def _(t):
    shown = preview(t("lineitem", *KEYS).withColumn("shown", F.lit(1)))
    found = t("lineitem", *KEYS).join(shown, list(KEYS), "left_semi").agg(F.count(F.lit(1)).alias("n_found"))
    both = row_count(shown).unionByName(found, allowMissingColumns=True)
    return both.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_found").alias("n_found"))
