import random
from contextlib import contextmanager

import pytest
from helpers import values

from tablewright import TableFunction
from tablewright.errors import PlanError
from tablewright.operators.ordered import running

SCANS = {
    "total": ("running_sum", "v"),
    "known": ("running_count", "v"),
    "low": ("running_min", "v"),
    "high": ("running_max", "v"),
    "place": ("row_number", None),
    "before": ("previous", "v"),
}


def brute(rows):
    out, seen, last = [], [], None
    for place, (k, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0])), 1):
        seen += [] if v is None else [v]
        total = (sum(seen), len(seen), min(seen), max(seen)) if seen else (None, 0, None, None)
        out.append((k, v, *total, place, last))
        last = v
    return sorted(out, key=repr)


@contextmanager
def dealt_to(spark, parts):
    """So many parts, however few rows they get."""
    wanted = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_like_one_pass_in_order(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice([None, *range(-50, 50)])) for k in rng.sample(range(1000), 300)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    with dealt_to(spark, parts):
        assert values(running(df, ["k"], SCANS, str(tmp_path))) == brute(rows)


def test_ties_are_spread_and_numbered_once(spark, tmp_path):
    df = spark.range(20_000).selectExpr("1 AS k", "id AS v")
    with dealt_to(spark, 8):
        out = running(df, ["k"], {"place": ("row_number", None), "total": ("running_sum", "v")}, str(tmp_path))
    assert sorted(r["place"] for r in out.select("place").collect()) == list(range(1, 20_001))
    assert out.agg({"total": "max"}).first()[0] == sum(range(20_000))
    (written,) = tmp_path.iterdir()
    sizes = [r["count"] for r in spark.read.parquet(str(written)).groupBy("__part").count().collect()]
    assert len(sizes) > 1
    assert max(sizes) < 10_000


def test_equal_rows_nulls_and_no_rows(spark, tmp_path):
    same = spark.createDataFrame([(1, None)] * 5, "k long, v long")
    got = running(same, ["k"], {"place": ("row_number", None), "total": ("running_sum", "v")}, str(tmp_path))
    assert values(got, "place", "total") == [(i, None) for i in range(1, 6)]
    assert running(same.limit(0), ["k"], SCANS, str(tmp_path)).collect() == []


def test_as_a_table_function(spark, tmp_path):
    fn = TableFunction(name="totals", fn=lambda df, folder: running(df, ["k"], {"total": ("running_sum", "v")}, folder), params={"folder": "str"})
    df = spark.createDataFrame([(2, 20), (1, 10)], "k long, v long")
    assert values(fn.fn(df, str(tmp_path))) == [(1, 10, 10), (2, 20, 30)]


@pytest.mark.parametrize("scan", [("median", "v"), ("running_sum", None)])
def test_unknown_scans(spark, tmp_path, scan):
    with pytest.raises(PlanError):
        running(spark.createDataFrame([(1, 1)], "k long, v long"), ["k"], {"x": scan}, str(tmp_path))
