import pytest
from helpers import values

from tablewright import Filter, TableSpec, TableStore
from tablewright.streaming.file_groups import csv_stream, ingest_batch, stream_into


@pytest.fixture
def setup(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, val long").schema
    store = TableStore(spark, str(tmp_path / "store"))
    store.register(TableSpec("sales", "id", schema))
    folder = tmp_path / "in"
    folder.mkdir()

    def land(name, *lines):
        (folder / name).write_text("\n".join(["id,val", *lines]) + "\n")

    def run(*steps):
        source = csv_stream(spark, str(folder), schema, files_per_batch=1)
        for step in steps:
            source = step.apply(source)
        query = stream_into(store, "sales", source, "landing", str(tmp_path / "progress"))
        query.awaitTermination(120)
        assert query.exception() is None

    return store, land, run


def test_each_file_once(setup):
    store, land, run = setup
    land("sales_1.csv", "a,1", "b,2", "a,9")
    run()
    land("sales_2.csv", "a,10", "c,3")
    run()
    run()
    assert values(store.read("sales")) == [("a", 10), ("b", 2), ("c", 3)]
    assert store.rows("sales").numbers() == [1, 2]


def test_steps_work_on_a_stream(setup):
    store, land, run = setup
    land("sales_1.csv", "a,1", "b,20")
    run(Filter("val", "gt", "10"))
    assert values(store.read("sales")) == [("b", 20)]


def test_a_repeated_batch_is_passed_over(spark, setup):
    store, _, _ = setup
    batch = spark.createDataFrame([("a", 1)], "id string, val long")
    assert ingest_batch(store, "sales", batch, 0, "s").ok
    assert ingest_batch(store, "sales", batch, 0, "s") is None
    assert ingest_batch(store, "sales", batch, 0, "other", "upsert").ok
    assert ingest_batch(store, "sales", batch, 0, "s") is None
    assert store.rows("sales").numbers() == [1, 2]


@pytest.fixture
def landing(spark, tmp_path):
    """Ingest the same lines as a stream and as a batch: rows of each, None where it was refused."""
    from tablewright import ingest_csv

    schema = spark.createDataFrame([], "id string, val long, name string").schema

    def both(*lines):
        folder = tmp_path / "both"
        folder.mkdir()
        (folder / "f.csv").write_text("\n".join(lines) + "\n")
        out = []
        for how in ("stream", "batch"):
            store = TableStore(spark, str(tmp_path / how))
            store.register(TableSpec("t", "id", schema))
            if how == "stream":
                query = stream_into(store, "t", csv_stream(spark, str(folder), schema), "s", str(tmp_path / "progress"))
                try:
                    query.awaitTermination(120)
                except Exception:  # noqa: BLE001 - looked at below
                    assert query.exception() is not None
            else:
                ingest_csv(store, "t", str(folder / "f.csv"), schema=schema)
            out.append(values(store.read("t"), "id", "val", "name") if store.rows("t").latest() else None)
        return out

    return both


@pytest.mark.parametrize("row", ["2,bad,x", "2,1,x,extra", "2,1", "2"])
def test_stream_and_batch_refuse_alike(landing, row):
    assert landing("id,val,name", "1,1,a", row) == [None, None]


def test_stream_and_batch_read_alike(landing):
    lines = ["id,val,name", '1,1,"a ""q"" b"', '2,,"x,y"', '3,3,""']
    stream, batch = landing(*lines)
    assert stream == batch
    assert batch[0] == ("1", 1, 'a "q" b')


def test_a_stream_refuses_another_column_order(landing):
    stream, batch = landing("name,id,val", "a,1,1")
    assert stream is None
    assert batch == [("1", 1, "a")]
