"""Every query of the package on the smallest tables, and the pipeline stage by stage."""

import os
from collections import Counter

import pytest
from compare import differences

import corpus_pipeline
from tablewright.llm import catalogue, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, FOLDER, catalogue.QUERIES[name], catalogue.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_covers_every_document(spark, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in catalogue.QUERIES[name](spark, FOLDER).select("doc_id").collect()} == ids


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    assert list(seen) == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]

    before, after = seen["quality"]
    scores = {r["doc_id"]: r["predicted"] for r in catalogue.QUERIES["op5_quality"](spark, FOLDER).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, p in scores.items() if p)

    before, after = seen["near_duplicates"]
    roots = {r["component_id"] for r in simhash.near_groups(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(roots)

    before, after = seen["repeated_passages"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    lowest = {}
    for i, t in sorted(texts.items()):
        w = t.split()
        for k in range(len(w) - 49):
            lowest.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts.items():
        w = t.split()
        gone = {j for k in range(len(w) - 49) if lowest[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        texts[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in texts.items() if t}

    before, after = seen["mixing"]
    assert sum(len(r["text"].split()) for r in after.collect()) == pytest.approx(1.5 * sum(len(r["text"].split()) for r in before.collect()), abs=20)

    before, after = seen["packing"]
    tokens = Counter()
    for r in after.collect():
        assert len(r["ids"]) == 4 * r["length"]
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == {r["doc_id"] for r in before.collect()}


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
