import pytest
from helpers import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import TableSpec, TableStore, ingest_csv, ingest_frame, ingest_group
from tablewright.errors import PlanError, StorageError
from tablewright.operators import keys as K
from tablewright.sources.files import infer_schema, list_files, match_tables, read_csv
from tablewright.sources.ingest import register_csv
from tablewright.sources.store import alphabetical
from tablewright.types import describe


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def sales(spark, store):
    schema = spark.createDataFrame([], "id string, val long").schema
    store.register(TableSpec("sales", "id", schema, "upsert", r"sales_\d+"))
    return store


def csv(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def v1(tmp_path):
    return csv(tmp_path, "v1.csv", "id,val", "r1,10", "r2,20")


def test_upsert_replaces_and_keeps(sales, tmp_path):
    assert ingest_csv(sales, "sales", v1(tmp_path)).rows_ingested == 2
    result = ingest_csv(sales, "sales", csv(tmp_path, "u.csv", "id,val", "r1,99", "r3,30"))
    assert (result.ok, result.rows_ingested, result.version) == (True, 2, 2)
    assert values(sales.read("sales")) == [("r1", 99), ("r2", 20), ("r3", 30)]


def test_upsert_rewrites_only_parts_it_touches(sales, spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, val long")
    ingest_frame(sales, "sales", frame(("a", 1), ("b", 2)))
    ingest_frame(sales, "sales", frame(("c", 3)))
    before = sales.rows("sales").latest()
    ingest_frame(sales, "sales", frame(("c", 33), ("d", 4)))
    after = sales.rows("sales").latest()
    (old,) = set(before.parts) - set(after.parts)
    c = sales.rows("sales").read_parts([old], before.schema)
    assert values(c) == [("c", 3)]
    assert after.notes["replaced_parts"] == 1
    assert after.notes["n_rows"] == 4
    assert values(sales.read("sales")) == [("a", 1), ("b", 2), ("c", 33), ("d", 4)]
    # The older version stays readable until it is vacuumed.
    assert values(sales.rows("sales").read(before)) == [("a", 1), ("b", 2), ("c", 3)]
    # What the latest version doesn't use is vacuumed, bucket by bucket.
    used = sales.rows("sales").vacuum().parts
    assert old not in used
    assert values(sales.read("sales")) == [("a", 1), ("b", 2), ("c", 33), ("d", 4)]
    assert old.split("/")[1] not in sales.rows("sales").folder.child(f"parts/{old.split('/')[0]}").names()
    sales.rows("sales").compact()
    assert len(sales.rows("sales").vacuum().parts) == 1
    assert sales.rows("sales").numbers() == [4]
    assert len(sales.rows("sales").folder.child("parts").names()) == 1
    assert values(sales.read("sales")) == [("a", 1), ("b", 2), ("c", 33), ("d", 4)]


def test_skip_inserts_new_keys_and_lists_the_others(sales, tmp_path):
    ingest_csv(sales, "sales", v1(tmp_path))
    result = ingest_csv(sales, "sales", csv(tmp_path, "s.csv", "id,val", "r1,99", "r3,30", "r1,98"), method="skip")
    assert result.rows_ingested == 1
    assert values(result.skipped) == [("r1",), ("r1",)]
    assert values(sales.read("sales")) == [("r1", 10), ("r2", 20), ("r3", 30)]


@pytest.mark.parametrize(
    ("rows", "reason"), [(["r1,5", "r9,6"], "exists"), (["r8,5", "r8,6"], "repeated"), (["r8,5", ",6"], "null")]
)
def test_append_is_all_or_nothing(sales, tmp_path, rows, reason):
    ingest_csv(sales, "sales", v1(tmp_path))
    result = ingest_csv(sales, "sales", csv(tmp_path, "a.csv", "id,val", *rows), method="append")
    assert not result.ok
    assert reason in result.error
    assert values(sales.read("sales")) == [("r1", 10), ("r2", 20)]
    ok = ingest_csv(sales, "sales", csv(tmp_path, "b.csv", "id,val", "r7,7"), method="APPEND")
    assert ok.rows_ingested == 1
    assert sales.read("sales").count() == 3


@pytest.mark.parametrize("method", ["upsert", "skip"])
def test_null_key_fails_the_batch(sales, tmp_path, method):
    result = ingest_csv(sales, "sales", csv(tmp_path, "n.csv", "id,val", "r1,1", ",2"), method=method)
    assert "NULL" in result.error
    assert sales.read("sales").count() == 0


def test_methods_and_names_are_checked(sales, spark, tmp_path):
    assert "unknown" in ingest_csv(sales, "sales", v1(tmp_path), method="merge").error
    assert ingest_csv(sales, "sales", str(tmp_path / "absent.csv")).error
    with pytest.raises(StorageError):
        ingest_csv(sales, "other", v1(tmp_path))
    with pytest.raises(StorageError):
        sales.register(sales.spec("sales"))
    with pytest.raises(PlanError):
        TableSpec("t", "id", spark.range(1).schema, "merge")


def test_first_row_of_a_repeated_key_wins(sales, tmp_path):
    lines = [f"k{i % 7},{i}" for i in range(700)]
    ingest_csv(sales, "sales", csv(tmp_path, "d.csv", "id,val", *lines))
    assert values(sales.read("sales")) == [(f"k{i}", i) for i in range(7)]


def test_file_order_across_files(sales, tmp_path):
    small = csv(tmp_path, "1.csv", "id,val", "a,1")
    large = csv(tmp_path, "2.csv", "id,val", *[f"a,{i}" for i in range(100, 900)])
    ingest_csv(sales, "sales", [large, small])
    assert values(sales.read("sales")) == [("a", 1)]


def test_drift_asks_first(sales, tmp_path):
    drifted = csv(tmp_path, "d.csv", "id,val,extra", "r1,x,1")
    result = ingest_csv(sales, "sales", drifted)
    assert result.requires_confirmation
    assert result.diff.added == ("extra",)
    assert result.diff.type_changes == (("val", "BIGINT", "VARCHAR"),)
    assert sales.rows("sales").latest() is None
    assert "cannot hold" in ingest_csv(sales, "sales", drifted, confirm_drift=True).error
    fine = csv(tmp_path, "f.csv", "id,val,extra", "r1,5,1")
    assert ingest_csv(sales, "sales", fine, confirm_drift=True).ok
    assert sales.read("sales").columns == ["id", "val"]
    gone = csv(tmp_path, "g.csv", "id", "r1")
    assert ingest_csv(sales, "sales", gone).diff.removed == ("val",)
    assert "missing" in ingest_csv(sales, "sales", gone, confirm_drift=True).error
    assert values(sales.read("sales")) == [("r1", 5)]


def test_writers_do_not_overwrite_each_other(sales, spark):
    df = spark.createDataFrame([("a", 1)], "id string, val long")
    rows = sales.rows("sales")
    part = rows.write_part(df)
    rows.commit([part], df.schema, None)
    with pytest.raises(StorageError):
        rows.commit([part], df.schema, None)


def test_inference_and_groups(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    csv(folder, "sales_01.csv", "id,val", "a,1")
    csv(folder, "sales_02.csv", "id,val", "b,2")
    csv(folder, "costs.csv", "id,day,at", "1,2024-01-02,2024-01-02 03:04:05")
    assert describe(infer_schema(spark, str(folder / "costs.csv"))) == [
        ("id", "BIGINT"), ("day", "DATE"), ("at", "TIMESTAMP"),
    ]
    listing = list_files(spark, str(folder))
    assert values(listing, "stem", "pattern") == [("costs", None), ("sales_01", r"sales_\d+"), ("sales_02", r"sales_\d+")]
    specs = [("bad", "(["), ("sales", r"sales_\d+"), ("later", ".*")]
    assert values(match_tables(listing, specs), "stem", "table_name") == [
        ("costs", "later"), ("sales_01", "sales"), ("sales_02", "sales"),
    ]
    schema = spark.createDataFrame([], "id string, val long").schema
    store.register(TableSpec("sales", "id", schema, "append", r"sales_\d+"))
    assert ingest_group(store, str(folder))["sales"].rows_ingested == 2
    assert values(store.read("sales")) == [("a", 1), ("b", 2)]


def test_quotes_spaces_and_wide_numbers(spark, tmp_path):
    path = csv(tmp_path, "q.csv", "t,h,s", '10:00:00,99999999999999999999,"say ""hi"", ok"', "11:00:00,1, x ")
    df = read_csv(spark, path)
    assert describe(df.schema) == [("t", "VARCHAR"), ("h", "HUGEINT"), ("s", "VARCHAR")]
    assert values(df, "t", "s") == [("10:00:00", 'say "hi", ok'), ("11:00:00", " x ")]
    broken = csv(tmp_path, "m.csv", "s,n", '"a', 'b",1')
    assert values(read_csv(spark, broken, multi_line=True)) == [("a\nb", 1)]


def test_explicit_schema_loses_nothing(sales, spark, tmp_path):
    path = csv(tmp_path, "e.csv", "id,val", "a,1", "b,x")
    schema = spark.createDataFrame([], "id string, val long").schema
    assert ingest_csv(sales, "sales", path, schema=schema).error
    assert ingest_csv(sales, "sales", v1(tmp_path), schema=schema).rows_ingested == 2


def test_registration_from_a_file(store, tmp_path):
    path = csv(tmp_path, "sales-2025.04.csv", "id,val", "a,1", "a,2")
    spec = register_csv(store, "sales", "id", path, "append")
    assert (spec.pattern, describe(spec.schema)) == (r"sales-\d+.\d+", [("id", "VARCHAR"), ("val", "BIGINT")])
    assert store.read("sales").count() == 0
    assert tuple(store.profile("sales").first()) == (0, 0, False)
    with pytest.raises(PlanError):
        register_csv(store, "other", "nope", path)
    with pytest.raises(PlanError):
        register_csv(store, "other", "id", path, "merge")


def test_summaries_and_column_order(spark, store):
    for name in ("one", "two"):
        store.register(TableSpec(name, "z", spark.createDataFrame([], "z int, a int").schema))
    ingest_frame(store, "two", spark.createDataFrame([(1, 2)], "z int, a int"))
    assert store.read("two").columns == ["a", "z"]
    assert alphabetical(spark.createDataFrame([(1, 2)], "z int, a int")).columns == ["a", "z"]
    rows = store.summaries().collect()
    assert [(r.table_name, r.columns, r.n_rows) for r in rows] == [
        ("two", "a INTEGER, z INTEGER", 1), ("one", "z INTEGER, a INTEGER", 0),
    ]


batches = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(stored=st.dictionaries(st.integers(0, 5), st.integers(0, 99)), batch=batches)
def test_key_semantics_equal_dictionaries(spark, stored, batch):
    schema = "k int, v int"
    base = spark.createDataFrame(sorted(stored.items()), schema)
    new = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch)], schema + ", n int")
    first = {k: v for k, v in reversed(batch)}
    upserted = K.upsert(base, new, "k", [F.col("n")])
    assert values(upserted) == sorted({**stored, **first}.items(), key=repr)
    assert values(K.upsert(upserted, new, "k", ["n"])) == values(upserted)
    assert values(K.skip(base, new, "k", ["n"])) == sorted({**first, **stored}.items(), key=repr)
    skipped = K.skipped_keys(base, new, "k").count()
    assert skipped + K.new_rows(base, new, "k").count() == len(batch)
    clean = len(set(k for k, _ in batch)) == len(batch) and not set(stored) & set(first)
    assert (K.append_conflicts(base, new, "k").count() == 0) == clean


def people(store, spark):
    store.register(TableSpec("people", "id", spark.createDataFrame([], "id string, name string, city string").schema))


@pytest.mark.parametrize("with_schema", [False, True])
def test_columns_are_found_by_each_files_header(spark, store, tmp_path, with_schema):
    people(store, spark)
    files = [csv(tmp_path, "h_1.csv", "id,name,city", "a,Ann,Rome"), csv(tmp_path, "h_2.csv", "id,city,name", "b,Oslo,Bob")]
    schema = store.spec("people").schema if with_schema else None
    assert ingest_csv(store, "people", files, schema=schema).rows_ingested == 2
    assert values(store.read("people"), "id", "name", "city") == [("a", "Ann", "Rome"), ("b", "Bob", "Oslo")]


@pytest.mark.parametrize("bad", ["c,x,y,EXTRA", "c", "c,x"])
@pytest.mark.parametrize("with_schema", [False, True])
def test_rows_of_another_width_are_refused(spark, store, tmp_path, bad, with_schema):
    people(store, spark)
    path = csv(tmp_path, "p.csv", "id,name,city", "a,Ann,Rome", bad)
    result = ingest_csv(store, "people", path, schema=store.spec("people").schema if with_schema else None)
    assert result.error is not None
    assert store.rows("people").latest() is None


def test_files_with_other_columns_are_refused(spark, store, tmp_path):
    people(store, spark)
    files = [csv(tmp_path, "p_1.csv", "id,name,city", "a,Ann,Rome"), csv(tmp_path, "p_2.csv", "id,name", "b,Bob")]
    assert "different columns" in ingest_csv(store, "people", files).error
    assert ingest_csv(store, "people", str(tmp_path / "none*.csv")).error is not None


def test_files_of_different_inferred_types(spark, tmp_path):
    files = [csv(tmp_path, "n_1.csv", "id,v", "1,2"), csv(tmp_path, "n_2.csv", "v,id", "2.5,x")]
    df = read_csv(spark, files)
    assert describe(df.schema) == [("id", "VARCHAR"), ("v", "DOUBLE")]
    assert values(df) == [("1", 2.0), ("x", 2.5)]


def test_unmatched_files_are_named(sales, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    csv(folder, "sales_1.csv", "id,val", "a,1")
    csv(folder, "other_2.csv", "id,val", "a,1")
    done = ingest_group(sales, str(folder))
    assert list(done) == ["sales"]
    assert [r["stem"] for r in done.unmatched.collect()] == ["other_2"]
    (folder / "sales_1.csv").unlink()
    nothing = ingest_group(sales, str(folder))
    assert dict(nothing) == {}
    assert nothing.unmatched.count() == 1


def test_one_replaced_row_rewrites_one_bucket(spark, store, monkeypatch):
    from tablewright.sources.versions import BUCKETS, VersionedTable

    store.register(TableSpec("wide", "id", spark.range(1).selectExpr("id", "id AS v").schema))
    ingest_frame(store, "wide", spark.range(20_000).selectExpr("id", "id AS v"))
    written = []
    real = VersionedTable.write_parts

    def counted(self, df, key):
        parts = real(self, df, key)
        written.append((len(parts), self.count_parts(parts, self.latest().schema)))
        return parts

    monkeypatch.setattr(VersionedTable, "write_parts", counted)
    ingest_frame(store, "wide", spark.createDataFrame([(7, -1)], "id long, v long"))
    assert [parts for parts, _ in written] == [1, 1]
    assert written[1][1] < 3 * 20_000 / BUCKETS
    assert store.read("wide").count() == 20_000
    assert values(store.read("wide").filter("v < 0")) == [(7, -1)]
    assert store.rows("wide").latest().notes["n_rows"] == 20_000


def test_unique_rows_are_not_sorted_to_find_the_first(spark):
    df = spark.range(100).selectExpr("id AS k", "id % 7 AS v")
    assert K.first_rows(df, "k", ["v"]).count() == 100
    plan = K.first_rows(df, "k", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_summaries_know_the_time_and_count_of_the_last_ingest(sales, tmp_path):
    assert [(r["n_rows"], r["ingested_at"]) for r in sales.summaries().collect()] == [(0, None)]
    ingest_csv(sales, "sales", v1(tmp_path))
    first = sales.summaries().first()
    assert first["n_rows"] == 2
    ingest_csv(sales, "sales", csv(tmp_path, "s.csv", "id,val", "r1,9", "r5,1", "r5,2"), method="skip")
    ingest_csv(sales, "sales", csv(tmp_path, "a.csv", "id,val", "r6,9"), method="append")
    last = sales.summaries().first()
    assert last["n_rows"] == sales.read("sales").count() == 4
    assert last["ingested_at"] > first["ingested_at"]


def test_one_row_rewrites_one_bucket_after_appends(spark, store):
    schema = spark.range(1).selectExpr("id", "id AS v").schema
    store.register(TableSpec("many", "id", schema, "append", buckets=200))
    for first in (0, 10_000):
        assert ingest_frame(store, "many", spark.range(first, first + 10_000).selectExpr("id", "id AS v")).ok
    before = store.rows("many").latest()
    assert store.spec("many").buckets == 200
    assert len(before.parts) == 400
    assert ingest_frame(store, "many", spark.createDataFrame([(7, -1)], "id long, v long"), "upsert").ok
    after = store.rows("many").latest()
    (old,) = set(before.parts) - set(after.parts)
    assert store.rows("many").count_parts([old], schema) < 150
    assert store.read("many").count() == after.notes["n_rows"] == 20_000
    assert values(store.read("many").filter("v < 0")) == [(7, -1)]


def test_a_table_has_a_bucket(spark):
    with pytest.raises(PlanError):
        TableSpec("t", "id", spark.range(1).schema, buckets=0)


def test_an_ingest_reads_its_input_once(sales, tmp_path, monkeypatch):
    import os

    from pyspark.sql.readwriter import DataFrameReader

    from tablewright.sources.versions import VersionedTable

    paths = [csv(tmp_path, f"o_{i}.csv", "id,val", f"a{i},{i}", f"b{i},{i}") for i in range(2)]
    scans, read, write = [], DataFrameReader.csv, VersionedTable.write_part
    monkeypatch.setattr(DataFrameReader, "csv", lambda self, *a, **k: scans.append(a) or read(self, *a, **k))

    def gone_after_the_first(self, df):
        if os.path.exists(paths[0]):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan csv") == 1
        part = write(self, df)
        for p in paths:
            if os.path.exists(p):
                os.remove(p)  # whatever comes later has only what was written
        return part

    monkeypatch.setattr(VersionedTable, "write_part", gone_after_the_first)
    assert ingest_csv(sales, "sales", paths).rows_ingested == 4
    assert len(scans) == 1
    assert values(sales.read("sales")) == [("a0", 0), ("a1", 1), ("b0", 0), ("b1", 1)]


@pytest.mark.parametrize(
    ("fields", "kind"),
    [
        (["1", "-2", "+3", ""], "BIGINT"),
        (["1", "99999999999999999999"], "HUGEINT"),
        (["1", "2.5", "1e3", " 4 ", "NaN", "Inf"], "DOUBLE"),
        (["99999999999999999999", "1.5"], "DOUBLE"),
        (["2024-01-02", "2023-12-31"], "DATE"),
        (["2024-02-30", "2024-01-02"], "VARCHAR"),
        (["2024-01-02 03:04", "2024-01-02T03:04:05.250000"], "TIMESTAMP"),
        (["2024-01-02", "2024-01-02 03:04:05"], "VARCHAR"),
        (["true", "FALSE"], "BOOLEAN"),
        (["true", "1"], "VARCHAR"),
        (["1", "x"], "VARCHAR"),
        (["", ""], "VARCHAR"),
        (["10:00", "nan"], "VARCHAR"),
    ],
)
def test_the_narrowest_type_of_a_column(spark, tmp_path, fields, kind):
    path = csv(tmp_path, "n.csv", "k,v", *[f"r{i},{f}" for i, f in enumerate(fields)])
    assert describe(infer_schema(spark, path)) == [("k", "VARCHAR"), ("v", kind)]
    got = read_csv(spark, path).select("v").collect()
    assert sum(r["v"] is None for r in got) == fields.count("")


def test_only_texts_like_a_timestamp_meet_its_parser(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablewright.sources.files import narrowest_types

    rows = [("1", "2.5", "2024-01-02", "true", "n/a", "2024-01-02T03:04:05Z"), ("2", "x", "2024-01-03", None, "10:00", "--:")]
    text = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    monkeypatch.setattr(F, "try_to_timestamp", lambda text, form: F.raise_error(F.concat(F.lit("parsed "), text)).cast("timestamp"))
    assert [kind for _, kind in describe(narrowest_types(text))] == ["BIGINT", "VARCHAR", "DATE", "BOOLEAN", "VARCHAR", "VARCHAR"]


@pytest.mark.parametrize(
    ("text", "moment"),
    [
        ("+12345-01-02 03:04", "+12345-01-02 03:04:00"),
        ("-2024-01-02 03:04", "-2024-01-02 03:04:00"),
        ("2024-01-02 T03:04", "2024-01-02 03:04:00"),
        ("2024-01-02t03:04:05.1", "2024-01-02 03:04:05.1"),
        ("2024-01-0203:04", "2024-01-02 03:04:00"),
        ("2024-01-02 03:04.5", "2024-01-02 03:04:00.5"),
        ("2024-02-30 03:04", None),
        ("2024-01-02 03:04:05Z", None),
        ("2024-01-02 03:04\n", None),
    ],
)
def test_spellings_of_a_timestamp(spark, text, moment):
    from pyspark.sql import functions as F

    from tablewright.sources.files import as_types, narrowest_types

    df = spark.createDataFrame([(text,)], "v string")
    kinds = narrowest_types(df)
    assert describe(kinds) == [("v", "TIMESTAMP" if moment else "VARCHAR")]
    assert as_types(df, kinds).select(F.col("v").cast("string")).first()[0] == (moment or text)


def test_many_tables_match_by_normal_form(spark):
    stems = ["sales_1", "sales_22", "sales", "a1b2", "ab1", "x", None]
    listing = spark.createDataFrame([(s, i) for i, s in enumerate(stems)], "stem string, path int")
    patterns = [(f"t{i}", rf"t{chr(97 + i % 26) * (i // 26 + 1)}_\d+") for i in range(500)]
    patterns += [("early", r"sales_\d\d"), ("sales", r"sales_\d+"), ("again", r"sales_\d+"), ("any", r"a.\d+"), ("two", r"a\d+b\d+"), ("x", "x"), ("none", None)]
    matched = match_tables(listing, patterns)
    assert values(matched, "stem", "table_name") == sorted(
        [("sales_1", "sales"), ("sales_22", "early"), ("sales", None), ("a1b2", "two"), ("ab1", "any"), ("x", "x"), (None, None)], key=repr
    )
    assert matched.columns == ["stem", "path", "table_name"]
    assert len(matched._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_the_profile_of_a_stored_table_reads_no_row(sales, tmp_path):
    ingest_csv(sales, "sales", v1(tmp_path))
    ingest_csv(sales, "sales", csv(tmp_path, "u.csv", "id,val", "r1,99", "r3,30"))
    noted = sales.profile("sales")
    assert "FileScan" not in noted._jdf.queryExecution().executedPlan().toString()
    assert tuple(noted.first()) == tuple(sales.profile("sales", exact=True).first()) == (3, 3, False)
