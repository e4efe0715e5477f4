import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import quality
from tablewright.llm.learning import held_out, labelled_sample
from tablewright.llm.texts import slices

DOCS = "doc_id long, text string, row string, score int"


def test_features_of_one_text_by_hand():
    (part,) = slices(pa.array(["The cat saw\nthe the CAT!! 12 ###"]))
    x = dict(zip(quality.FEATURES, quality.quality_features(part)[0], strict=True))
    assert x["words"] == pytest.approx(np.log1p(8))
    assert x["word_length"] == pytest.approx(25 / 8)
    assert x["letters"] == pytest.approx(18 / 25)
    assert x["digits"] == pytest.approx(2 / 25)
    assert x["capitals"] == pytest.approx(4 / 25)
    assert x["shouts"] == pytest.approx(2 / 8)
    assert x["symbols"] == pytest.approx(3 / 25)
    assert x["odd_endings"] == pytest.approx(2 / 8)
    assert x["lines"] == pytest.approx(1 / 8)
    assert x["distinct_words"] == pytest.approx(7 / 8)
    assert x["repeated_neighbours"] == pytest.approx(1 / 8)
    assert x["commonest_word"] == pytest.approx(2 / 8)
    assert x["distinct_pairs"] == 1


def test_features_do_not_depend_on_neighbours():
    texts = ["", "a b c a b", None, "x", "  ", "Ünï! code " * 50]
    together = np.concatenate([quality.quality_features(p) for p in slices(pa.array(texts), 40)])
    alone = np.concatenate([quality.quality_features(p) for t in texts for p in slices(pa.array([t], pa.string()))])
    assert np.allclose(together, alone)
    assert (together[[0, 2, 4]] == 0).all()


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    plain, paired = quality.fit_additive(x, y, n_pairs=0), quality.fit_additive(x, y, n_pairs=1)
    assert paired.pairs == [(0, 1)]
    right = [((m.score(x) > 0.5) == y).mean() for m in (plain, paired)]
    assert right[0] < 0.65
    assert right[1] > 0.9


def test_constant_without_two_classes():
    x = np.zeros((0, 2))
    assert quality.fit_additive(x, np.zeros(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert quality.fit_additive(np.zeros((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] == pytest.approx(0.95)


def rows():
    good = [(i, f"The cat number {i} sat on the mat, and it slept well there. So did dog {i}.", "r", 1) for i in range(60)]
    return good + [(100 + i, f"### {i} !!! $$$ {i} *** %%%", "r", 0) for i in range(60)]


def test_scores_and_filter(spark):
    docs = spark.createDataFrame([*rows(), (900, None, "r", 1), (None, "", "r", 1), (3, rows()[3][1], "r", 1)], DOCS)
    labels = spark.createDataFrame([*[(r[0], r[3]) for r in rows()], (None, 1), (5, None), (7, 0), (7, 1), (4444, 0)], "doc_id long, quality int")
    got = {(r["doc_id"], r["predicted"]): r for r in quality.quality_scores(docs, labels).collect()}
    assert {k for k in got if k[0] is not None and k[0] < 900} == {(r[0], r[3]) for r in rows()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.quality_scores(docs, labels).count() == 123
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows() if r[3]}
    assert not {r["doc_id"] for r in kept.collect()} & {r[0] for r in rows() if not r[3]}


def test_sample_avoids_the_held_out_fold(spark):
    import zlib

    docs = spark.createDataFrame(rows(), DOCS)
    labels = docs.selectExpr("doc_id", "score AS quality")
    ids = {r["doc_id"] for r in labelled_sample(docs, labels, "quality").collect()}
    assert ids == {r[0] for r in rows() if zlib.crc32(str(r[0]).encode()) % 5}
    assert labelled_sample(docs, labels, "quality", most=10).count() == 10
    out = docs.select("doc_id", held_out(docs["doc_id"]).alias("out")).collect()
    assert {r["doc_id"] for r in out if not r["out"]} == ids


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    docs = spark.range(100_000).selectExpr("2L AS doc_id", "concat('text ', id % 1000) AS text", "1 AS label").union(
        spark.createDataFrame([(1, "a", 0), (3, None, 0), (3, None, 0)], "doc_id long, text string, label int")
    )
    labels = spark.createDataFrame([(i, q, 0) for i in (1, 2, 3, 4) for q in (0, 1)], "doc_id long, quality int, toxic int")
    for most in (2, 20_000):
        sample = labelled_sample(docs, labels, "quality", most).collect()
        assert len(sample) == len({r["doc_id"] for r in sample}) <= most
        assert {r["label"] for r in sample} == {1}
    assert {r["doc_id"]: r["text"] for r in sample}[1] == "a"
