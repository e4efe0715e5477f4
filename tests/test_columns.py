import pytest
from helpers import values
from pyspark.sql import functions as F

from tablewright import ColumnFunction, FunctionStep, Rename, ValueFunction, cols
from tablewright.errors import PlanError, UnknownColumnError
from tablewright.naming import distinct_names, label_column, normalize_label, short_id, short_id_column, unused_name
from tablewright.sources.export import json_rows


@pytest.fixture(scope="module")
def multi(spark):
    rows = [("r1", 10, 11, 12), ("r2", 20, 21, 22), ("r3", 30, 31, 32)]
    return spark.createDataFrame(rows, "id string, a long, b long, c long")


@pytest.mark.parametrize(
    ("renames", "expected"),
    [
        ({"a": "b", "b": "a"}, ["id", "b", "a", "c"]),
        ({"a": "b", "b": "c", "c": "z"}, ["id", "b", "c", "z"]),
        ({"a": "a"}, ["id", "a", "b", "c"]),
        ({"A": "x.y z"}, ["id", "x.y z", "b", "c"]),
    ],
)
def test_rename_is_simultaneous(multi, renames, expected):
    df = Rename(renames).apply(multi)
    assert df.columns == expected
    assert values(df)[0] == ("r1", 10, 11, 12)


def test_rename_checks(multi):
    with pytest.raises(UnknownColumnError):
        Rename({"nope": "x"}).apply(multi)
    with pytest.raises(PlanError):
        Rename({"a": "b"}).apply(multi)
    for bad in ({}, {"a": " "}, {"": "x"}, {"a": "x", "b": "X"}):
        with pytest.raises(PlanError):
            Rename(bad)


double = ColumnFunction(name="dbl", params={"x": "column"}, fn=lambda x: x * 2)
plus = ColumnFunction(name="plus", params={"x": "column", "y": "column"}, fn=lambda x, y: x + y)


def run(df, *args, **options):
    return FunctionStep(*args, **options).transform(df, df)[0]


def test_append_names(multi):
    assert run(multi, double, {"x": cols("a", "b")}).columns[4:] == ["dbl_a", "dbl_b"]
    assert run(multi, double, {"x": cols("a", "b")}, append_name="c").columns[4:] == ["c_2", "c_3"]
    assert run(multi, plus, {"x": cols("a"), "y": cols("b")}).columns[4:] == ["plus_a_b"]


def test_replace_reads_the_input_only(multi):
    df = run(multi, double, {"x": cols("a", "b")}, output="replace", targets=("b", "c"))
    assert values(df, "a", "b", "c")[0] == (10, 20, 22)
    df = run(multi, double, {"x": cols("a", "b")}, output="replace")
    assert values(df, "a", "b", "c")[0] == (20, 22, 12)


def test_replace_needs_targets_for_several_columns(multi):
    step = FunctionStep(plus, {"x": cols("a"), "y": cols("b")}, output="replace")
    with pytest.raises(PlanError):
        step.transform(multi, multi)
    several = FunctionStep(plus, {"x": cols("a", "b"), "y": cols("c")}, output="replace", targets=("z",))
    with pytest.raises(PlanError):
        several.transform(multi, multi)


def test_value_fills_every_row(multi):
    total = ValueFunction(name="total a", fn=lambda: F.sum("a"))
    df = run(multi, total, {})
    assert df.columns[-1] == "total_a"
    assert {r.total_a for r in df.collect()} == {60}


@pytest.mark.parametrize(
    ("raw", "label"), [("__x", "x"), ("a b/c", "a_b_c"), ("a\x1fb", "a_b"), ("", "result"), (None, "result"), ("--", "result")]
)
def test_labels(spark, raw, label):
    assert normalize_label(raw) == label
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(label_column(F.col("s"))).first()[0] == label


def test_names():
    assert unused_name("a", ["A", "a_2"]) == "a_3"
    assert distinct_names(["a", "id", "id_1", "b", "ID", "id_1"]) == ["a", "id", "id_1", "b", "ID_2", "id_1_1"]


def test_result_ids_agree(spark):
    df = spark.createDataFrame([("f", "a\x1fb", "täble")], "a string, b string, c string")
    assert df.select(short_id_column(F.col("a"), F.col("b"), F.col("c"))).first()[0] == short_id("f", "a\x1fb", "täble")
    assert short_id("f", "", "t") == short_id("f", "", "t") != short_id("f", "x", "t")


def test_json_rows_hold_no_nan(spark):
    df = spark.sql("SELECT double('NaN') a, double('Infinity') b, 1.5D c, CAST(NULL AS STRING) d")
    assert json_rows(df).first()[0] == '{"a":null,"b":null,"c":1.5,"d":null}'
