import pytest
from helpers import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import Filter, Join, Pivot, Rename, TableSpec, TableStore, Workspace, compose
from tablewright.errors import PlanError, TransformedCycleError, UnknownColumnError
from tablewright.naming import transformed_id
from tablewright.operators.joins import equi_join
from tablewright.plans.run import effective_columns


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, value long")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "id long, extra string")
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 3), ("right", 3), ("full", 4)])
@pytest.mark.parametrize("skew", ["auto", "split"])
def test_join_types(sides, how, n, skew):
    left, right = sides
    df = Join(right, [("id", "id")], how, skew=skew).apply(left)
    assert df.columns == ["id", "value", "id_1", "extra"]
    assert df.count() == n


def test_null_keys_never_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4)], "key string, lval long")
    right = spark.createDataFrame([("a", 100), ("b", 200), (None, 300), ("z", 400)], "key string, rval long")
    inner = Join(right, [("key", "key")]).apply(left)
    assert values(inner, "lval", "rval") == [(1, 100), (3, 200)]
    full = Join(right, [("key", "key")], "full").apply(left)
    assert full.count() == 6


def test_text_key_matches_number(spark):
    left = spark.createDataFrame([(1,), (2,)], "n int")
    right = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "k string, v string")
    assert values(Join(right, [("n", "k")], "left").apply(left)) == [(1, "1", "a"), (2, None, None)]


def test_keys_are_checked_on_their_side(sides):
    left, right = sides
    with pytest.raises(UnknownColumnError):
        Join(right, [("extra", "id")]).apply(left)
    with pytest.raises(UnknownColumnError):
        Join(right, [("id", "value")]).apply(left)
    for bad in ({"on": []}, {"on": [("id", "")]}, {"on": [("id", "id")], "how": "cross"}):
        with pytest.raises(PlanError):
            Join(right, **bad)


keys = st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=keys, b=keys, how=st.sampled_from(["inner", "left", "right", "full"]))
def test_split_join_equals_plain_join(spark, a, b, how):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(a)], "k int, l int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(b)], "k int, r int")
    on = [("k", "k")]
    assert values(equi_join(left, right, on, how, skew="split")) == values(equi_join(left, right, on, how, skew="plain"))


@pytest.mark.parametrize(("a", "b"), [("int", "long"), ("long", "int"), ("int", "double"), ("int", "decimal(10,2)")])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_keys_of_different_types_meet(spark, a, b, how):
    left = spark.range(60).selectExpr(f"CAST(id % 3 AS {a}) AS k", "id AS l")
    right = spark.range(40).selectExpr(f"CAST(id % 4 AS {b}) AS k", "id AS r")
    split = equi_join(left, right, [("k", "k")], how, skew="split")
    assert values(split) == values(equi_join(left, right, [("k", "k")], how, skew="plain"))


def test_composite_keys_with_nulls(spark):
    left = spark.createDataFrame([(1, "a", 0), (1, None, 1), (None, "a", 2), (2, "b", 3)], "k int, m string, l int")
    right = spark.createDataFrame([(1, "a", 10), (1, None, 11), (3, "c", 12)], "k int, m string, r int")
    on = [("k", "k"), ("m", "m")]
    assert values(equi_join(left, right, on, "full"), "l", "r") == [(0, 10), (1, None), (2, None), (3, None), (None, 11), (None, 12)]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_unknown_side_is_split_and_a_unique_one_is_not(spark):
    left = spark.range(9).selectExpr("id AS k", "id AS l")
    right = spark.range(9).selectExpr("id AS k", "id AS r")
    assert "LeftOuter" not in plan(equi_join(left, right, [("k", "k")], "left"))
    assert "LeftOuter" in plan(equi_join(left, right, [("k", "k")], "left", unique=("right",)))
    assert "FullOuter" not in plan(equi_join(left, right, [("k", "k")], "full", unique=("right",)))
    assert "FullOuter" in plan(equi_join(left, right, [("k", "k")], "full", unique=("left", "right")))


def test_a_stored_key_is_known_to_be_unique(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    right = spark.range(9).selectExpr("id AS k", "id AS r")
    store.register(TableSpec("right", "k", right.schema))
    left = spark.range(9).selectExpr("id AS k", "id AS l")
    ws = Workspace(spark, store)
    for on, expected in (([("k", "k")], True), ([("l", "r")], False), ([("l", "r"), ("k", "k")], True)):
        df = Join("right", on, "left").apply(left, ws.view("t"))
        assert ("LeftOuter" in plan(df) or "LocalRelation" in plan(df) and "Union" not in plan(df)) is expected


def test_planning_runs_no_job(spark):
    left = spark.range(400).selectExpr("id AS l", "CAST(0 AS LONG) AS k")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k long, r string")
    status = spark.sparkContext.statusTracker()
    before = status.getJobIdsForGroup()
    df = equi_join(left, right, [("k", "k")], "full")
    assert status.getJobIdsForGroup() == before
    assert df.count() == 401
    assert values(df.filter("l IS NULL"), "r") == [("y",)]


def workspace(spark, store=None):
    left = spark.createDataFrame([(i, i * 10) for i in range(1, 5)], "id long, lval long")
    right = spark.createDataFrame([(1, 50), (2, 150), (3, 90), (4, 200)], "id long, amount long")
    return (
        Workspace(spark, store)
        .add("right", right, [Filter("amount", "gt", "100")])
        .add("plain", right)
        .add("left", left, [Join("right", [("id", "id")], use_transformed=True)])
        .add("left_raw", left, [Join("right", [("id", "id")])])
        .add("left_plain", left, [Join("plain", [("id", "id")], use_transformed=True)])
    )


def test_transformed_side_is_composed_when_never_run(spark):
    ws = workspace(spark)
    assert values(compose(ws, "left", "transforms").frame, "id") == [(2,), (4,)]
    assert compose(ws, "left_raw", "transforms").frame.count() == 4
    assert compose(ws, "left_plain", "transforms").frame.count() == 4


def test_effective_columns(spark):
    left = spark.createDataFrame([(1, "x")], "id long, v string")
    steps = [Join("plain", [("id", "id")]), Filter("amount", "gt", "1"), Rename({"v": "w"})]
    ws = workspace(spark).add("t", left, steps)
    assert effective_columns(ws, "t", 0) == [("id", "BIGINT"), ("v", "VARCHAR")]
    assert [name for name, _ in effective_columns(ws, "t", 1)] == ["id", "v", "id_1", "amount"]
    assert [name for name, _ in effective_columns(ws, "t", 3)] == ["id", "w", "id_1", "amount"]


def test_lineage(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    ws = workspace(spark, store)
    assert compose(ws, "left", "transforms").entries[0].consumed_result_id == transformed_id("right", 0)
    assert compose(ws, "left_raw", "transforms").entries[0].consumed_result_id is None
    compose(ws, "right", "transforms").execute()
    assert compose(ws, "left", "transforms").entries[0].consumed_result_id == transformed_id("right", 1)


def test_a_snapshot_is_used_as_it_is(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    ws = workspace(spark, store)
    store.write_snapshot("right", spark.createDataFrame([(3, 1)], "id long, amount long"))
    assert values(compose(ws, "left", "transforms").frame, "id") == [(3,)]


def test_cycle_fails_the_step_and_names_the_tables(spark):
    df = spark.createDataFrame([(1,)], "id long")
    ws = (
        Workspace(spark)
        .add("a", df, [Join("c", [("id", "id")], use_transformed=True)])
        .add("c", df, [Join("a", [("id", "id")], use_transformed=True)])
    )
    entry = compose(ws, "a", "transforms").entries[0]
    assert entry.status == "failed"
    assert "a -> c -> a" in entry.error
    with pytest.raises(TransformedCycleError):
        ws.view("a").resolve("a", "transformed")


def test_stored_table_spec_needs_its_key(spark):
    with pytest.raises(PlanError):
        TableSpec("t", "nope", spark.range(1).schema)


@pytest.fixture(scope="module")
def quarters(spark):
    rows = [("east", "q1", 10.0), ("west", "q1", 20.0), ("east", "q2", 30.0), ("west", "q2", None)]
    return spark.createDataFrame(rows, "region string, quarter string, amount double")


def test_pivot_sum(quarters):
    df = Pivot("quarter", {"amount": ("sum",)}, ("region",)).apply(quarters)
    assert df.columns == ["region", "q1", "q2"]
    assert values(df) == [("east", 10.0, 30.0), ("west", 20.0, None)]


def test_pivot_names_counts_and_null_values(spark, quarters):
    more = quarters.union(spark.createDataFrame([("north", None, 5.0), ("south", "q1", 1.0)], quarters.schema))
    df = Pivot("quarter", {"amount": ("sum", "count")}, ("region",)).apply(more)
    assert df.columns == ["region", "q1_sum(amount)", "q1_count(amount)", "q2_sum(amount)", "q2_count(amount)"]
    assert values(df)[1:3] == [("north", None, 0, None, 0), ("south", 1.0, 1, None, 0)]


def test_pivot_values_may_differ_in_case_or_equal_an_index_name(spark):
    rows = [("x", "a", 1), ("x", "A", 2), ("x", "region", 3)]
    df = spark.createDataFrame(rows, "region string, q string, n long")
    out = Pivot("q", {"n": ("max",)}, ("region",)).apply(df)
    assert out.columns == ["region", "A", "a_1", "region_1"]
    assert [tuple(r) for r in out.collect()] == [("x", 2, 1, 3)]


def test_pivot_repeats_an_aggregation_under_a_new_name(spark):
    df = spark.range(200).selectExpr("id % 7 AS g", "nullif(id % 4, 3) AS p", "nullif(id % 5, 0) AS v")
    out = Pivot("p", [("v", ("sum", "count", "sum"))], ("g",)).apply(df)
    assert out.columns[1:4] == ["0_sum(v)", "0_count(v)", "0_sum(v)_1"]
    assert all(r[1] == r[3] for r in out.collect())


def test_pivot_checks(quarters):
    for bad in (("", {"amount": ("sum",)}), ("quarter", {}), ("quarter", {"amount": ("median",)})):
        with pytest.raises(PlanError):
            Pivot(*bad)
    with pytest.raises(UnknownColumnError):
        Pivot("quarter", {"nope": ("sum",)}, ("region",)).apply(quarters)


def test_too_many_pivot_values_is_an_error(spark):
    df = spark.range(20).selectExpr("id", "id AS v", "1 AS g")
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        with pytest.raises(PlanError):
            Pivot("id", {"v": ("sum",)}, ("g",)).apply(df)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
