"""Type migration of text columns derived from the tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import query
from tablewright.operators.casts import cast_column, cast_of, castability, nullified_keys
from tablewright.operators.keys import converted_key_counts, converted_key_violations
from tablewright.sources.files import narrowest_types
from tablewright.types import describe, normalize_frame, shared_columns

# One formatted number per row: currency, percent, accounting negative, spaces, digit groups, junk.
AMOUNT = """CASE l_linenumber
    WHEN 1 THEN concat('$', CAST(l_partkey AS STRING), ',', lpad(CAST(l_suppkey AS STRING), 3, '0'), '.50')
    WHEN 2 THEN concat(CAST(l_suppkey AS STRING), '.5%')
    WHEN 3 THEN concat('(', CAST(l_partkey AS STRING), ',500)')
    WHEN 4 THEN concat('  ', CAST(l_suppkey AS STRING), ' ')
    WHEN 5 THEN concat('1 ', CAST(l_orderkey AS STRING), '_000')
    WHEN 6 THEN concat('n/a ', l_returnflag)
    ELSE NULL END AS amount"""
AMOUNTS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", AMOUNT)
AMOUNTS_SQL = f"(SELECT {', '.join(AMOUNTS)} FROM lineitem)"


# Signs that dress a number up and carry no value.
DRESS = " || ".join(["'$€£¥%(), '", *(f"chr({c})" for c in range(9, 14))])


def number_sql(column: str, target: str) -> str:
    """A dressed-up number as another type: bare digits, turned negative by enclosing parentheses, and
    hundredths where there is a percent sign."""
    bare = f"try_cast(translate({column}, {DRESS}, '') AS DOUBLE)"
    signed = f"if(starts_with(trim({column}), '(') AND ends_with(trim({column}), ')'), -{bare}, {bare})"
    return f"try_cast(if(position('%' IN {column}) > 0, {signed} * 0.01, {signed}) AS {target})"


for name, target in (("cast_number", "DOUBLE"), ("cast_number_int", "INTEGER"), ("cast_number_big", "BIGINT")):

    def run(t, target=target):
        df = t("lineitem", *AMOUNTS)
        return df.withColumn("converted", cast_of(df, "amount", target))

    query(name, f"SELECT *, {number_sql('amount', target)} AS converted FROM {AMOUNTS_SQL}")(run)

# A date in one of several spellings, some of them not a date.
DAY = """CASE l_linenumber
    WHEN 1 THEN concat(CAST(year(l_shipdate) AS STRING), '-', CAST(month(l_shipdate) AS STRING), '-07')
    WHEN 2 THEN concat(CAST(year(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING), '/31')
    WHEN 3 THEN concat(' ', CAST(year(l_shipdate) AS STRING), '-02-30 ')
    WHEN 4 THEN CAST(year(l_shipdate) AS STRING)
    WHEN 5 THEN concat(CAST(year(l_shipdate) AS STRING), '-12-01 10:20:30')
    WHEN 6 THEN concat(CAST(year(l_shipdate) AS STRING), '-12-01 ', l_returnflag)
    ELSE concat('2024-01', '-05T1:2:3.25') END AS day"""
DAYS = ("l_orderkey", "l_linenumber", DAY)
DAYS_SQL = f"(SELECT {', '.join(DAYS)} FROM lineitem)"


@query("cast_date", f"SELECT *, TRY_CAST(day AS DATE) AS converted FROM {DAYS_SQL}")
def _(t):
    df = t("lineitem", *DAYS)
    return df.withColumn("converted", cast_of(df, "day", "DATE"))


@query("cast_timestamp", f"SELECT *, TRY_CAST(day AS TIMESTAMP) AS converted FROM {DAYS_SQL}")
def _(t):
    df = t("lineitem", *DAYS)
    return df.withColumn("converted", cast_of(df, "day", "TIMESTAMP"))


WORD = """CASE l_linenumber WHEN 1 THEN 'true' WHEN 2 THEN 'No' WHEN 3 THEN ' yes ' WHEN 4 THEN '1'
    WHEN 5 THEN 'off' WHEN 6 THEN 'F' ELSE l_returnflag END AS word"""
WORDS = ("l_orderkey", "l_linenumber", WORD)


@query(
    "cast_bool",
    f"SELECT *, TRY_CAST(word AS BOOLEAN) AS converted FROM (SELECT {', '.join(WORDS)} FROM lineitem)",
)
def _(t):
    df = t("lineitem", *WORDS)
    return df.withColumn("converted", cast_of(df, "word", "BOOLEAN"))


MIXED = ("l_orderkey", "l_extendedprice * 1000 AS big", "l_discount / 1000 AS small", "l_shipdate", "l_suppkey")


@query(
    "cast_text",
    f"""SELECT * REPLACE (CAST(big AS VARCHAR) AS big, CAST(small AS VARCHAR) AS small,
            CAST(l_shipdate AS VARCHAR) AS l_shipdate, CAST(l_suppkey AS VARCHAR) AS l_suppkey)
        FROM (SELECT {', '.join(MIXED)} FROM lineitem)""",
)
def _(t):
    columns = ("big", "small", "l_shipdate", "l_suppkey")
    return reduce(lambda df, c: cast_column(df, c, "VARCHAR"), columns, t("lineitem", *MIXED))


@query(
    "cast_round_half_even",
    """SELECT *, TRY_CAST(half AS INTEGER) AS converted
       FROM (SELECT l_orderkey, l_quantity / 2 AS half FROM lineitem)""",
)
def _(t):
    df = t("lineitem", "l_orderkey", "l_quantity / 2 AS half")
    return df.withColumn("converted", cast_of(df, "half", "INTEGER"))


@query(
    "castability",
    f"""SELECT count(*) FILTER (WHERE NOT bad) AS castable, count(*) FILTER (WHERE bad) AS uncastable
        FROM (SELECT {number_sql('amount', 'DOUBLE')} IS NULL AND amount IS NOT NULL AS bad FROM {AMOUNTS_SQL})""",
)
def _(t):
    return castability(t("lineitem", *AMOUNTS), "amount", "DOUBLE")


@query(
    "nullified_keys",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS pk, 'amount' AS "column" FROM {AMOUNTS_SQL}
        WHERE {number_sql('amount', 'INTEGER')} IS NULL AND amount IS NOT NULL""",
)
def _(t):
    return nullified_keys(t("lineitem", *AMOUNTS), "l_orderkey", "amount", "INTEGER")


BALANCES = {
    "customer": (
        "customer",
        "c_custkey",
        "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE CAST(c_nationkey AS STRING) END AS code",
    ),
    "supplier": ("supplier", "s_suppkey", "CASE WHEN s_acctbal < 2000 THEN s_name ELSE '7%' END AS code"),
    "nation": ("nation", "n_nationkey", "n_regionkey AS code"),
}


@query(
    "migrate_shared",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, CAST({key} AS VARCHAR) AS pk FROM (SELECT {key}, {code} FROM {name})
            WHERE {number_sql('code', 'INTEGER')} IS NULL AND code IS NOT NULL"""
        for name, key, code in (BALANCES["customer"], BALANCES["supplier"])
    ),
)
def _(t):
    """The keys losing their value in every table that has ``code`` as text."""
    frames = {name: t(source, key, code) for name, (source, key, code) in BALANCES.items()}
    sharing = shared_columns({name: df.schema for name, df in frames.items()}, "code")["VARCHAR"]
    parts = [
        nullified_keys(frames[name], BALANCES[name][1], "code", "INTEGER").select(
            F.lit(name).alias("table_name"), "pk"
        )
        for name in sharing
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "normalize_types",
    """SELECT event_id, CAST(to_json({'user': user_id, 'kind': event_type}) AS VARCHAR) AS who,
              CAST(to_json([event_id, user_id]) AS VARCHAR) AS ids FROM events""",
)
def _(t):
    who, ids = "struct(user_id AS user, event_type AS kind) AS who", "array(event_id, user_id) AS ids"
    return normalize_frame(t("events", "event_id", who, ids))


# Keys of which some meet in one number, and some are none.
CODE = """CASE p_size % 3
    WHEN 0 THEN CAST(p_partkey AS STRING)
    WHEN 1 THEN concat('0', CAST(p_partkey - 1 AS STRING))
    ELSE CASE WHEN p_partkey % 50 < 5 THEN concat('#', CAST(p_partkey AS STRING)) ELSE concat(CAST(p_partkey AS STRING), ',000') END
    END AS code"""
CODES_SQL = f"(SELECT code, {number_sql('code', 'BIGINT')} AS v FROM (SELECT {CODE} FROM part))"


@query(
    "migrated_key_counts",
    f"""SELECT count(*) FILTER (v IS NOT NULL OR code IS NULL) AS castable,
               count(*) FILTER (v IS NULL AND code IS NOT NULL) AS uncastable,
               count(*) FILTER (v IS NULL) AS null_rows,
               (SELECT count(*) FROM (SELECT v FROM {CODES_SQL} WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1)) AS repeated_keys
        FROM {CODES_SQL}""",
)
def _(t):
    return converted_key_counts(t("part", CODE), "code", "BIGINT")


@query(
    "migrated_key_violations",
    f"""SELECT CAST(v AS VARCHAR) AS key, count(*) AS n_rows, if(v IS NULL, 'null', 'repeated') AS reason
        FROM {CODES_SQL} GROUP BY v HAVING count(*) > 1 OR v IS NULL""",
)
def _(t):
    return converted_key_violations(t("part", CODE), "code", "BIGINT")


TEXTS = {
    "whole": "CAST(l_orderkey AS STRING)",
    "huge": "concat(CAST(l_orderkey AS STRING), '00000000000000000000')",
    "number": "CAST(l_quantity AS STRING)",
    "day": "concat('2024-0', CAST(l_linenumber AS STRING), '-15')",
    "moment": "concat('2024-0', CAST(l_linenumber AS STRING), '-15 10:20')",
    "flag": "CASE WHEN l_linenumber > 3 THEN 'true' ELSE 'False' END",
    "mixed": "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END",
    "empty": "nullif(l_returnflag, l_returnflag)",
}
KINDS_SQL = [
    ("BIGINT", "if(regexp_full_match(v, '[+-]?[0-9]+'), try_cast(v AS BIGINT), NULL)"),
    ("HUGEINT", "if(regexp_full_match(v, '[+-]?[0-9]+'), try_cast(v AS HUGEINT), NULL)"),
    ("DOUBLE", "try_cast(v AS DOUBLE)"),
    ("DATE", "if(length(v) = 10, try_cast(v AS DATE), NULL)"),
    ("TIMESTAMP", "try_strptime(v, '%Y-%m-%d %H:%M')"),
    ("BOOLEAN", "if(lower(v) IN ('true', 'false'), true, NULL)"),
]


@query(
    "narrowest_types",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name,
                   CASE WHEN count(v) = 0 THEN 'VARCHAR' {' '.join(f"WHEN count(v) = count({e}) THEN '{k}'" for k, e in KINDS_SQL)}
                   ELSE 'VARCHAR' END AS kind FROM (SELECT {text} AS v FROM lineitem)"""
        for name, text in TEXTS.items()
    ),
)
def _(t):
    """The types of an ingest without a schema, from one aggregate over the text of all columns."""
    text = t("lineitem", *[f"{expression} AS {name}" for name, expression in TEXTS.items()])
    return text.sparkSession.createDataFrame(describe(narrowest_types(text)), "column_name string, kind string")
