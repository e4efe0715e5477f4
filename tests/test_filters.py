import itertools
import re

import pytest
from helpers import column, day, moment

from tablewright import DateCondition, DateRange, Filter
from tablewright.errors import PlanError, UnknownColumnError


READINGS = [
    ("k0", -4.5, "pump A"),
    ("k1", 0.0, "Pump B"),
    ("k2", 7.25, ""),
    ("k3", 7.25, None),
    ("k4", None, "valve_pump"),
    ("k5", 1e9, "valve%"),
]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame(READINGS, "id string, level double, tag string")


def holds(compare):
    """The condition as Python sees it, with NULL failing."""
    return lambda value: value is not None and compare(value)


# In a value that is searched for, _ stands for any character and % for any run of them.
@pytest.mark.parametrize(
    ("name", "operator", "value", "passes"),
    [
        ("level", "eq", "7.25", holds(lambda x: x == 7.25)),
        ("level", "neq", "0", holds(lambda x: x != 0)),
        ("level", "gt", "0", holds(lambda x: x > 0)),
        ("level", "gte", "7.25", holds(lambda x: x >= 7.25)),
        ("level", "lt", "-4", holds(lambda x: x < -4)),
        ("level", "lte", "0", holds(lambda x: x <= 0)),
        ("LEVEL", "gt", "1e8", holds(lambda x: x > 1e8)),
        ("tag", "contains", "pump", holds(lambda x: "pump" in x)),
        ("tag", "contains", "_p", holds(lambda x: re.search(".p", x))),
        ("tag", "contains", "e%", holds(lambda x: "e" in x)),
        ("tag", "not_contains", "pump", holds(lambda x: "pump" not in x)),
        ("tag", "eq", "' OR tag <> '", holds(lambda x: False)),
        ("tag", "is_null", None, lambda x: x is None),
        ("level", "is_not_null", None, lambda x: x is not None),
    ],
)
def test_operators(readings, name, operator, value, passes):
    place = {"level": 1, "tag": 2}[name.lower()]
    assert column(Filter(name, operator, value).apply(readings), "id") == [r[0] for r in READINGS if passes(r[place])]


def test_backslash_is_an_ordinary_character(spark):
    df = spark.createDataFrame([("a\\b",), ("a%b",), ("ab",)], "s string")
    assert column(Filter("s", "contains", "\\").apply(df), "s") == ["a\\b"]


def test_filters_chain(readings):
    both = Filter("tag", "is_not_null").apply(Filter("level", "lt", "8").apply(readings))
    assert column(both, "id") == ["k0", "k1", "k2"]


def test_unknown_column(readings):
    with pytest.raises(UnknownColumnError):
        Filter("pressure", "eq", "1").apply(readings)


@pytest.mark.parametrize("args", [("", "eq", "1"), ("a", "like", "1"), ("a", "eq", None), ("a", "gt", "")])
def test_bad_configuration(args):
    with pytest.raises(PlanError):
        Filter(*args)


@pytest.mark.parametrize(
    ("kind", "text", "hits"),
    [
        ("int", "20.0", 1),
        ("int", "19.5", 1),
        ("int", "2_0", 1),
        ("int", "21", 0),
        ("double", "2e1", 1),
        ("decimal(10,2)", "20.001", 1),
        ("boolean", "Yes", 1),
        ("date", "2024-01-05 10:00:00", 1),
        ("date", "2024/01/05", 1),
        ("timestamp_ntz", "2024-01-05", 1),
        ("timestamp", "2024-01-05T00:00:00", 1),
        ("string", "20", 1),
    ],
)
def test_literals_take_the_column_type(spark, kind, text, hits):
    stored = {"boolean": "true", "date": "2024-01-05", "timestamp_ntz": "2024-01-05", "timestamp": "2024-01-05"}
    df = spark.sql(f"SELECT CAST('{stored.get(kind, '20')}' AS {kind}) AS v")
    assert Filter("v", "eq", text).apply(df).count() == hits


@pytest.mark.parametrize(("kind", "text"), [("int", "abc"), ("int", "99999999999"), ("date", "2024-02-30"), ("boolean", "on")])
def test_unreadable_literal_fails_the_plan(spark, kind, text):
    df = spark.sql(f"SELECT CAST(NULL AS {kind}) AS v")
    with pytest.raises(PlanError):
        Filter("v", "gt", text).apply(df)


STAYS = [
    ("s0", "2023-05-02", "2023-05-09"),
    ("s1", "2023-05-31", "2023-06-04"),
    ("s2", "2023-06-01", None),
    ("s3", None, "2023-08-20"),
    ("s4", "2023-09-15", "2023-09-15"),
    ("s5", None, None),
]


@pytest.fixture(scope="module")
def stays(spark):
    rows = [(i, a and moment(a), b and moment(b)) for i, a, b in STAYS]
    return spark.createDataFrame(rows, "id string, came timestamp_ntz, went timestamp_ntz")


@pytest.mark.parametrize(
    ("groups", "kept"),
    [
        ([[("came", "2023-05-02", "2023-05-31")]], ["s0", "s1"]),
        ([[("came", "2023-06-01", None)]], ["s2", "s4"]),
        ([[("came", None, "2023-05-31")]], ["s0", "s1"]),
        ([[("came", "2023-05-01", "2023-05-30")], [("went", "2023-08-01", "2023-08-31")]], ["s0", "s3"]),
        ([[("came", "2023-05-01", None), ("went", None, "2023-06-30")]], ["s0", "s1"]),
        ([[("went", "", "2022-12-31")]], []),
    ],
)
def test_date_groups(stays, groups, kept):
    step = DateRange([[DateCondition(*c) for c in group] for group in groups])
    assert column(step.apply(stays), "id") == kept
    assert column(step.apply(stays.limit(0)), "id") == []


@pytest.mark.parametrize(("start", "end"), [("2020-02-28", "2020-03-01"), ("2020-02-29", None), (None, "2020-02-29"), ("2020-03-01", "2020-03-01")])
def test_bounds_are_inclusive(spark, start, end):
    days = [f"2020-02-{d}" for d in (27, 28, 29)] + [f"2020-03-0{d}" for d in (1, 2)]
    df = spark.createDataFrame([(day(d),) for d in days] + [(None,)], "d date")
    inside = [day(d) for d in days if (start or d) <= d <= (end or d)]
    assert column(DateRange([[DateCondition("d", start, end)]]).apply(df), "d") == inside


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_the_last_day_counts_whole(spark, kind):
    text = ["2025-03-31 23:59:00", "2025-01-01 00:00:00", "2025-04-01 00:00:01"]
    df = spark.createDataFrame(list(enumerate(text, 1)), "id long, t string").selectExpr("id", f"CAST(t AS {kind}) ts")
    step = DateRange([[DateCondition("ts", "2025-01-01", "2025-03-31")]])
    assert column(step.apply(df), "id") == [1, 2]


def test_groups_equal_brute_force(spark):
    days = [None, "2025-01-15", "2025-06-30", "2025-07-01", "2025-12-31"]
    rows = [(i, a and day(a), b and day(b)) for i, (a, b) in enumerate(itertools.product(days, days))]
    df = spark.createDataFrame(rows, "id long, eff date, ship date")
    step = DateRange(
        [
            [DateCondition("eff", "2025-01-01", "2025-03-31"), DateCondition("ship", end="2025-06-30")],
            [DateCondition("eff", "2025-07-01")],
        ]
    )

    def passes(eff, ship):
        first = eff is not None and ship is not None and eff <= day("2025-03-31") and ship <= day("2025-06-30")
        return first or (eff is not None and eff >= day("2025-07-01"))

    assert column(step.apply(df), "id") == sorted((i for i, a, b in rows if passes(a, b)), key=repr)


@pytest.mark.parametrize(
    "build",
    [
        lambda: DateRange([]),
        lambda: DateRange([[]]),
        lambda: DateCondition("", "2025-01-01"),
        lambda: DateCondition("d"),
        lambda: DateCondition("d", "2025-02-01", "2025-01-01"),
        lambda: DateCondition("d", "soon"),
    ],
)
def test_bad_date_range(build):
    with pytest.raises(PlanError):
        build()


def test_text_dates_are_refused(spark):
    df = spark.createDataFrame([("2025-01-01",)], "d string")
    with pytest.raises(PlanError):
        DateRange([[DateCondition("d", "2025-01-01")]]).apply(df)
