import pytest
from helpers import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.casts import (
    cast_column,
    cast_of,
    castability,
    check_migration_type,
    nullified_keys,
    plain_cast,
    to_text,
)
from tablewright.types import (
    SchemaDiff,
    normalize_frame,
    normalize_type,
    schema_diff,
    shared_columns,
    spark_type,
    type_name,
)


def convert(spark, texts, target):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    rows = df.select("i", cast_of(df, "v", target)).orderBy("i").collect()
    return {t: r[1] for t, r in zip(texts, rows, strict=True)}


def test_formatted_numbers(spark):
    assert convert(spark, ["$1,234.50", "50%", "12.5%", "(2,500)", "  99  ", "1 234", "€5", "£7", "¥9"], "DOUBLE") == {
        "$1,234.50": 1234.5, "50%": 0.5, "12.5%": 0.125, "(2,500)": -2500.0, "  99  ": 99.0, "1 234": 1234.0,
        "€5": 5.0, "£7": 7.0, "¥9": 9.0,
    }
    assert convert(spark, ["(1", "( 1,234 )", "-(5)", "(50%)", "1,2,3", "$", "-", "", "1d", "abc", "1_000"], "DOUBLE") == {
        "(1": 1.0, "( 1,234 )": -1234.0, "-(5)": -5.0, "(50%)": -0.5, "1,2,3": 123.0, "$": None, "-": None,
        "": None, "1d": None, "abc": None, "1_000": 1000.0,
    }


def test_integers_round_half_to_even_and_stay_in_range(spark):
    assert convert(spark, ["2.5", "3.5", "-2.5", "9999999999", "inf", "nan"], "INTEGER") == {
        "2.5": 2, "3.5": 4, "-2.5": -2, "9999999999": None, "inf": None, "nan": None,
    }
    assert convert(spark, ["9999999999"], "bigint") == {"9999999999": 9999999999}


def test_amount_fixtures(spark):
    ok = spark.createDataFrame([("A", "1000"), ("B", "2,500"), ("C", "250,000"), ("D", "12,345.67")], "p string, v string")
    assert tuple(castability(ok, "v", "DOUBLE").first()) == (4, 0)
    bad = spark.createDataFrame([("A", "250,000"), ("B", "abc"), ("C", None)], "p string, v string")
    assert tuple(castability(bad, "v", "DOUBLE").first()) == (2, 1)
    assert values(nullified_keys(bad, "p", "v", "DOUBLE")) == [("B", "v")]
    assert values(cast_column(bad, "v", "DOUBLE")) == [("A", 250000.0), ("B", None), ("C", None)]


DATES = {
    "2024-01-05": "2024-01-05", "2024/1/5": "2024-01-05", " 2024-01-05 ": "2024-01-05", "2024-01": None,
    "2024": None, "2024-01-05 10:00:00": "2024-01-05", "2024-01-05 abc": None, "20240105": None,
    "2024-13-01": None, "2024-02-30": None, "24-01-05": "0024-01-05", "2024-01/05": None, "2024-01-05 10:60:00": None,
}


def test_dates(spark):
    got = convert(spark, list(DATES), "DATE")
    assert {k: v and v.isoformat() for k, v in got.items()} == DATES


TIMES = {
    "2024-01-05": "2024-01-05 00:00:00", "2024/01/05 10:11:12": "2024-01-05 10:11:12", "2024-01-05 ": None,
    " 2024-01-05 10:00": "2024-01-05 10:00:00", "2024-01-05 10": None, "2024-01-05T1:2:3.25": "2024-01-05 01:02:03.250000",
    "2024-01-05 10:00:00 UTC": "2024-01-05 10:00:00", "2024-01-05 10:00:00+02": "2024-01-05 10:00:00",
    "2024-01-05 25:00:00": None, "2024-01": None,
}


def test_timestamps(spark):
    got = convert(spark, list(TIMES), "TIMESTAMP")
    assert {k: v and v.isoformat(sep=" ") for k, v in got.items()} == TIMES


def test_booleans(spark):
    got = convert(spark, ["true", "T", "yes", "1", "No", "0", " true ", "on", "2"], "BOOLEAN")
    assert list(got.values()) == [True, True, True, True, False, False, None, None, None]


@pytest.mark.parametrize(
    ("number", "text"),
    [(1e20, "1e+20"), (1.5e-7, "1.5e-07"), (100.0, "100.0"), (1e15, "1000000000000000.0"), (12345678.9, "12345678.9"),
     (0.0001, "0.0001"), (1e-5, "1e-05"), (-3e7, "-30000000.0"), (float("inf"), "inf"), (None, None)],
)
def test_number_text(spark, number, text):
    df = spark.createDataFrame([(number,)], "d double")
    assert df.select(to_text(F.col("d"), T.DoubleType())).first()[0] == text


def test_casts_from_other_types(spark):
    df = spark.sql("SELECT 2.5D d, 3000000000L l, true b, DATE'2024-01-02' t, ARRAY(1, 2) a, 5 i")
    cast = lambda c, t: df.select(cast_of(df, c, t)).first()[0]
    assert (cast("d", "INTEGER"), cast("l", "INTEGER"), cast("i", "BOOLEAN")) == (2, None, True)
    assert (cast("b", "VARCHAR"), cast("t", "VARCHAR"), cast("a", "VARCHAR")) == ("true", "2024-01-02", "[1,2]")
    assert (cast("b", "INTEGER"), cast("i", "DATE"), cast("t", "TIMESTAMP").isoformat()) == (None, None, "2024-01-02T00:00:00")


def test_plain_casts_keep_whole_numbers_exact(spark):
    texts = ["9007199254740993", " 5 ", "2.5", "-2.5", "1e3", "1_000", "1d", "x", "99999999999999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cast = plain_cast(F.col("t"), T.StringType(), T.LongType())
    got = [r[0] for r in df.orderBy("i").select(cast).collect()]
    assert got == [9007199254740993, 5, 3, -3, 1000, 1000, None, None, None]


def test_migration_targets():
    assert check_migration_type("integer") == "INTEGER"
    for bad in ("FLOAT", "JSON", "", None):
        with pytest.raises(ValueError):
            check_migration_type(bad)


@pytest.mark.parametrize(
    ("raw", "known"),
    [("varchar(100)", "VARCHAR"), ("DECIMAL(18,3)", "DECIMAL"), ("JSON", "VARCHAR"), ("UUID", "VARCHAR"), ("STRUCT(a INT)", "VARCHAR"),
     ("INTEGER[]", "VARCHAR"), ("timestamp with time zone", "TIMESTAMP"), ("", "VARCHAR"), (None, "VARCHAR"), ("hugeint", "HUGEINT")],
)
def test_vocabulary(raw, known):
    assert normalize_type(raw) == known


def test_spark_types_round_trip():
    for name in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "FLOAT", "DOUBLE", "VARCHAR", "DATE", "TIMESTAMP",
                 "TIMESTAMPTZ", "BOOLEAN"):
        assert type_name(spark_type(name)) == name
    assert spark_type("DECIMAL(10,2)") == T.DecimalType(10, 2)
    assert type_name(T.BinaryType()) == "VARCHAR"


def test_nested_columns_become_text(spark):
    df = normalize_frame(spark.sql("SELECT STRUCT(1 AS x) s, MAP('k', 2) m, 1 n"))
    assert tuple(df.first()) == ('{"x":1}', '{"k":2}', 1)


def test_drift(spark):
    old = spark.createDataFrame([], "id int, d string, gone long, n long").schema
    new = spark.createDataFrame([], "id long, d date, n double, extra boolean").schema
    assert schema_diff(old, new) == SchemaDiff(("extra",), ("gone",), (("n", "BIGINT", "DOUBLE"),))
    assert not schema_diff(old, old)
    assert shared_columns({"a": old, "b": new, "c": old}, "N") == {"BIGINT": ["a", "c"], "DOUBLE": ["b"]}
