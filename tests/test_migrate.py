import pytest
from helpers import values

from tablewright import TableSpec, TableStore, ingest_frame, migrate_column


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for name, rows in (("quirky", [("a", "123"), ("b", "abc"), ("c", "456")]), ("other", [("x", "7"), ("y", None)])):
        df = spark.createDataFrame(rows, "id string, mixed string")
        store.register(TableSpec(name, "id", df.schema))
        assert ingest_frame(store, name, df).ok
    return store


def test_dry_run_changes_nothing(store):
    result = migrate_column(store, "quirky", "mixed", "INTEGER", dry_run=True)
    assert (result.castable, result.uncastable, result.shared_tables) == (2, 1, ["other", "quirky"])
    assert store.rows("quirky").numbers() == [1]


def test_abort_refuses(store):
    result = migrate_column(store, "quirky", "mixed", "INTEGER")
    assert (result.ok, result.error, result.uncastable) == (False, "uncastable_rows", 1)
    assert dict(store.read("quirky").dtypes)["mixed"] == "string"


def test_nullify_reports_keys(store):
    result = migrate_column(store, "quirky", "mixed", "INTEGER", on_uncastable="nullify")
    assert (result.ok, result.rows_migrated) == (True, 3)
    assert values(result.nullified) == [("b", "mixed")]
    assert values(store.read("quirky")) == [("a", 123), ("b", None), ("c", 456)]
    assert dict(store.read("other").dtypes)["mixed"] == "string"
    assert store.spec("quirky").schema["mixed"].dataType.simpleString() == "int"
    assert migrate_column(store, "quirky", "mixed", "INTEGER").rows_migrated == 0


def test_shared_scope_changes_every_table(store):
    result = migrate_column(store, "other", "mixed", "BIGINT", "all_shared", "nullify")
    assert result.rows_migrated == 5
    assert values(result.nullified) == [("b", "mixed")]
    assert values(store.read("other")) == [("x", 7), ("y", None)]
    assert dict(store.read("quirky").dtypes)["mixed"] == "bigint"


def test_shared_abort_checks_every_table(store):
    result = migrate_column(store, "other", "mixed", "BIGINT", "all_shared")
    assert (result.ok, result.uncastable) == (False, 1)
    assert "quirky" in result.reason
    assert dict(store.read("other").dtypes)["mixed"] == "string"
    assert migrate_column(store, "other", "mixed", "BIGINT").ok


def test_a_failed_write_publishes_nothing(store, monkeypatch):
    from tablewright.sources.versions import VersionedTable

    write, calls = VersionedTable.write_part, []

    def second_fails(self, df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("disk gone")
        return write(self, df)

    monkeypatch.setattr(VersionedTable, "write_part", second_fails)
    result = migrate_column(store, "other", "mixed", "BIGINT", "all_shared", "nullify")
    assert (result.ok, result.error) == (False, "migration_failed")
    assert store.rows("other").numbers() == store.rows("quirky").numbers() == [1]


@pytest.mark.parametrize(
    ("table", "column", "kind", "error"),
    [
        ("quirky", "mixed", "JSON", "invalid_column_type"),
        ("quirky", "nope", "DATE", "column_not_found"),
        ("nope", "mixed", "DATE", "source_not_found"),
    ],
)
def test_bad_requests(store, table, column, kind, error):
    assert migrate_column(store, table, column, kind).error == error


@pytest.fixture
def keyed(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "keyed"))
    for name, keys in (("people", ["1", "01", "x", "7"]), ("plain", ["1", "2", "3"])):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "id string, n int")
        store.register(TableSpec(name, "id", df.schema, buckets=4))
        assert ingest_frame(store, name, df).ok
    return store


def test_a_converted_key_that_repeats_or_is_null_changes_nothing(keyed):
    before = values(keyed.read("people"))
    dry = migrate_column(keyed, "people", "id", "BIGINT", dry_run=True)
    assert (dry.ok, dry.castable, dry.uncastable, dry.broken_keys) == (True, 3, 1, 2)
    assert migrate_column(keyed, "people", "id", "BIGINT").error == "uncastable_rows"
    result = migrate_column(keyed, "people", "id", "BIGINT", on_uncastable="nullify")
    assert (result.ok, result.error, result.broken_keys) == (False, "migration_failed", 2)
    assert values(result.violations, "key", "n_rows", "reason") == [("1", 2, "repeated"), (None, 1, "null")]
    assert "'1' (2 rows) in 'people'" in result.reason
    assert values(keyed.read("people")) == before
    assert keyed.rows("people").numbers() == [1]


def test_a_broken_key_of_one_table_keeps_all_as_they_were(keyed):
    result = migrate_column(keyed, "plain", "id", "BIGINT", "all_shared", "nullify")
    assert (result.ok, result.error) == (False, "migration_failed")
    assert "'people'" in result.reason
    assert keyed.rows("plain").numbers() == keyed.rows("people").numbers() == [1]
    assert migrate_column(keyed, "plain", "id", "BIGINT").ok
    assert values(keyed.read("plain")) == [(1, 0), (2, 1), (3, 2)]


def test_a_migrated_table_keeps_its_buckets(keyed, spark):
    assert migrate_column(keyed, "plain", "n", "BIGINT").ok
    parts = keyed.rows("plain").latest().parts
    assert len(parts) > 1
    assert all("__bucket=" in p for p in parts)
    assert ingest_frame(keyed, "plain", spark.createDataFrame([("1", 10)], "id string, n long")).ok
    assert len(set(parts) - set(keyed.rows("plain").latest().parts)) == 1
    assert values(keyed.read("plain")) == [("1", 10), ("2", 1), ("3", 2)]
    assert keyed.rows("plain").latest().notes["n_rows"] == 3


@pytest.mark.parametrize("failing", ["second version", "last step"])
def test_a_failure_before_the_last_step_leaves_every_table_as_it_was(store, monkeypatch, failing):
    from tablewright.sources.folder import Folder

    before = {t: values(store.read(t)) for t in ("quirky", "other")}
    create, rename, made = Folder.create_json, Folder.rename, []

    def created(self, name, value):
        made.append(name)
        if failing == "second version" and sum(n.startswith("v") for n in made) == 2:
            raise OSError("disk gone")
        create(self, name, value)

    def renamed(self, name, to):
        # Everything is written, nothing is visible yet.
        assert store.rows("quirky").numbers() == store.rows("other").numbers() == [1]
        if failing == "last step" and not to.endswith(".dropped.json"):
            raise OSError("name node gone")
        return rename(self, name, to)

    monkeypatch.setattr(Folder, "create_json", created)
    monkeypatch.setattr(Folder, "rename", renamed)
    result = migrate_column(store, "other", "mixed", "BIGINT", "all_shared", "nullify")
    assert (result.ok, result.error) == (False, "migration_failed")
    monkeypatch.undo()
    assert {t: values(store.read(t)) for t in before} == before
    assert store.rows("quirky").numbers() == store.rows("other").numbers() == [1]
    assert migrate_column(store, "other", "mixed", "BIGINT", "all_shared", "nullify").ok
    assert store.rows("quirky").numbers() == store.rows("other").numbers() == [1, 2]


def test_a_change_whose_writer_died_is_invisible_and_can_be_taken_back(store, spark, monkeypatch):
    from tablewright.errors import StorageError
    from tablewright.sources import together

    class Died(BaseException):
        pass

    def dies(*_):
        raise Died

    monkeypatch.setattr(together.Folder, "rename", dies)
    monkeypatch.setattr(together, "_take_back", dies)
    with pytest.raises(Died):
        migrate_column(store, "other", "mixed", "BIGINT", "all_shared", "nullify")
    monkeypatch.undo()
    rows = store.rows("other")
    assert rows.numbers() == [1]
    assert dict(store.read("quirky").dtypes)["mixed"] == "string"
    with pytest.raises(StorageError):
        rows.commit([], store.spec("other").schema, rows.latest())
    assert len(store.drop_pending()) == 1
    assert store.drop_pending() == []
    assert ingest_frame(store, "other", spark.createDataFrame([("z", "9")], "id string, mixed string")).ok
    assert store.rows("other").numbers() == [1, 2]


def test_a_change_of_several_tables_gives_way_to_another_writer(store):
    drafts = {t: store.rows(t).draft([], store.spec(t).schema, store.rows(t).latest()) for t in ("other", "quirky")}
    quirky = store.rows("quirky")
    quirky.commit(quirky.latest().parts, store.spec("quirky").schema, quirky.latest())
    with pytest.raises(Exception, match="already exists"):
        store.publish(drafts)
    assert store.rows("other").numbers() == [1]
    assert quirky.numbers() == [1, 2]
    assert store.read("quirky").count() == 3
