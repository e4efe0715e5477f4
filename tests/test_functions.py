import pytest
from helpers import values
from pyspark.sql import functions as F

from tablewright import ChunkFunction, ColumnFunction, FunctionStep, RowFunction, SeriesFunction, SqlFunction, cols
from tablewright.errors import BundleLengthError, MixedShapeError, PlanError, RequiredParamError, UnboundColumnError
from tablewright.functions.binding import pair_columns, resolve_calls


def test_bundles():
    assert pair_columns({"x": cols("a"), "y": cols("b")}) == [({"x": "a", "y": "b"}, "a\x1fb")]
    assert pair_columns({"x": cols("a", "b"), "y": cols("c")}) == [
        ({"x": "a", "y": "c"}, "a"), ({"x": "b", "y": "c"}, "b"),
    ]
    assert [key for _, key in pair_columns({"x": cols("a", "b"), "y": cols("c", "d")})] == ["a\x1fc", "b\x1fd"]
    assert pair_columns({}) == [({}, "")]
    with pytest.raises(BundleLengthError):
        pair_columns({"x": cols("a", "b"), "y": cols("c", "d", "e")})


def test_values_defaults_and_shapes():
    params = {"x": "column", "n": "int", "b": "bool", "d": "date"}
    call = resolve_calls(params, {"n": "3", "d": "2024-01-02"}, {"x": cols("a"), "b": "YES"})[0]
    assert (call.values["n"], call.values["b"], call.values["d"].isoformat()) == (3, True, "2024-01-02")
    assert resolve_calls(params, {"n": "3", "d": "2024-01-02"}, {"b": "no", "n": 9})[0].values["n"] == 9
    with pytest.raises(RequiredParamError):
        resolve_calls(params, {}, {"x": cols("a")})
    with pytest.raises(MixedShapeError):
        resolve_calls({"x": "column", "n": "int"}, {}, {"x": cols("a"), "n": cols("b")})
    with pytest.raises(PlanError):
        resolve_calls({"n": "int"}, {}, {"n": "many"})
    with pytest.raises(PlanError):
        resolve_calls({}, {}, {"n": 1})


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("r1", 10, "east"), ("r2", 20, "west"), ("r3", 30, "east")]
    return spark.createDataFrame(rows, "id string, amount long, region string")


def run(df, *args, raw=None, **options):
    return FunctionStep(*args, **options).transform(df, raw or df)[0]


def test_row_function_sees_none(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    fn = RowFunction(
        name="describe",
        params={"n": "int", "s": "str", "mark": "str"},
        fn=lambda n, s, mark: f"{'none' if n is None else n}{mark}{s}",
    )
    out = run(df, fn, {"n": cols("n"), "s": cols("s"), "mark": "-"}, append_name="d")
    assert values(out, "d") == [("1-a",), ("none-b",)]
    assert run(df.limit(0), fn, {"n": cols("n"), "s": cols("s"), "mark": "-"}).count() == 0


def test_series_function_must_be_rowwise(spark):
    with pytest.raises(PlanError):
        SeriesFunction(name="centre", params={"x": "column"}, fn=lambda x: x - x.mean())


def test_chunks_are_never_whole_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        fn = ChunkFunction(name="sizes", fn=lambda part: part.head(1).assign(n=len(part))[["n"]], schema="n long")
        out = run(spark.range(0, 100, 1, 2), fn)
        assert max(r.n for r in out.collect()) == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def template(text, **more):
    return SqlFunction(name="t", params={"c": "column", "min_val": "int"}, defaults={"min_val": "15"}, text=text, **more)


def test_sql_defaults_and_hostile_values(sales):
    fn = template("SELECT * FROM {source_table} WHERE IDENTIFIER(:c) > :min_val")
    assert values(run(sales, fn, {"c": cols("amount")}), "id") == [("r2",), ("r3",)]
    assert values(run(sales, fn, {"c": cols("amount"), "min_val": "25"}), "id") == [("r3",)]
    with pytest.raises(PlanError):
        run(sales, fn, {"c": cols("amount; DROP TABLE x")})
    named = SqlFunction(name="n", params={"who": "str"}, text="SELECT * FROM {source_table} WHERE region = :who")
    assert run(sales, named, {"who": "east' OR '1'='1"}).count() == 0


def test_sql_without_parameters_reads_the_raw_table(sales):
    count = "SELECT count(*) AS n FROM {source_table}"
    working = sales.limit(1)
    assert run(working, SqlFunction(name="n", text=count), raw=sales).first()[0] == 3
    assert run(working, SqlFunction(name="n", text=count, reads="working"), raw=sales).first()[0] == 1


def test_table_parameters_name_the_input(sales):
    fn = SqlFunction(
        name="above", params={"rows": "table"}, text="SELECT * FROM {rows} WHERE amount > (SELECT min(amount) FROM {rows})"
    )
    assert values(run(sales, fn), "id") == [("r2",), ("r3",)]


def test_bad_functions():
    for build in (
        lambda: ColumnFunction(name="f", fn=F.upper, params={"x": "table"}),
        lambda: ColumnFunction(name="f", fn=F.upper, kind="check"),
        lambda: ColumnFunction(name="f", fn=F.upper, params={"x": "series"}),
        lambda: ColumnFunction(name="f", fn=F.upper, params={"x": "column"}, defaults={"x": 1}),
        lambda: SqlFunction(name="f", text=" "),
        lambda: SqlFunction(name="f", text="SELECT 1", reads="other"),
        lambda: FunctionStep(ColumnFunction(name="f", fn=F.upper), output="insert"),
    ):
        with pytest.raises(PlanError):
            build()


def test_unbound_column(sales):
    fn = ColumnFunction(name="f", params={"x": "column"}, fn=F.upper)
    with pytest.raises(UnboundColumnError):
        run(sales, fn, {})
