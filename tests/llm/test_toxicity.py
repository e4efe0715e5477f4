import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import toxicity as T

DOCS = "doc_id long, text string, toxic int, abusive string"


def test_evidence_ignores_case_and_punctuation():
    parts = [next(iter(T.slices(pa.array([t])))) for t in ("Idiot!", "(idiot)", "idiot", "idiots")]
    found = [set(T.evidence_buckets(p)[1].tolist()) for p in parts]
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 2  # the word, and its first four bytes
    assert found[0] & found[3]
    assert found[0] != found[3]


def test_evidence_of_odd_texts():
    for text in ("", "...", "é", "!!! ??? a", "\n"):
        for part in T.slices(pa.array([text])):
            owner, bucket, counts = T.evidence_buckets(part)
            assert len(owner) == len(bucket)
            assert len(counts) == 1
            assert T.evidence_features(part, np.array([5]), T.places(np.array([5]))).shape == (1, 4)


def test_long_runs_of_punctuation_take_one_pass():
    (part,) = T.slices(pa.array(["- " * 3 + "-" * 400_000 + "Idiot" + "-" * 400_000 + " " + "-" * 400_000]))
    begin = time.perf_counter()
    found = T.evidence_buckets(part)[1].tolist()
    assert time.perf_counter() - begin < 2
    assert sorted(found) == sorted(T.evidence_buckets(next(T.slices(pa.array(["idiot"]))))[1].tolist())


def test_newton_finds_the_log_odds():
    x = np.array([[0.0]] * 100 + [[1.0]] * 100)
    y = np.array([1.0] * 20 + [0.0] * 80 + [1.0] * 70 + [0.0] * 30)
    p = T.linear(np.array([[0.0], [1.0]]), T.fit_linear(x, y, ridge=1e-6))
    assert p == pytest.approx([0.2, 0.7], abs=1e-3)


def test_later_models_use_earlier_categories():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    first = (x[:, 0] > 0).astype(float)
    chain = T.fit_chain(x, np.stack([first, first], axis=1), np.zeros(0, np.int64))
    assert len(chain.models[1]) == len(chain.models[0]) + 1
    assert chain.models[1][2] > 1
    p = chain.probabilities(x)
    assert ((p[:, 1] > 0.5) == first).mean() > 0.95


def test_out_of_fold_probabilities_do_not_see_the_row():
    x = np.eye(400)  # every row has a feature of its own, so a model that has seen a row knows its answer
    y = np.random.default_rng(3).integers(0, 2, 400).astype(float)
    chain = T.fit_chain(x, np.stack([y, y], axis=1), np.zeros(0, np.int64))
    inside = T.linear(x, chain.models[0])
    assert ((inside > 0.5) == y).all()
    fed_its_own = T.fit_linear(np.concatenate([x, inside[:, None]], axis=1), y)
    assert fed_its_own[400] > 2
    assert chain.models[1][400] < 0.5


def rows(n=400, seed=0):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ran", "sol", "mer", "tiv", "pon") for b in ("da", "ki", "lo", "mu", "ne", "pa")]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 80))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["Scoundrel,", "knave", "knaves!", "ROGUE"]))
        out.append((i, " ".join(words), int(bad), "x"))
    return out


def test_held_out_documents(spark):
    data = rows()
    docs = spark.createDataFrame([*data, (1000, None, 0, "x"), (None, "", 0, "x"), (3, data[3][1], 0, "x")], DOCS)
    labels = spark.createDataFrame([*[(r[0], r[2]) for r in data], (None, 1), (9999, 1), (2, None)], "doc_id long, toxic int")
    got = T.toxicity_scores(docs, labels).collect()
    assert len(got) == len(data) + 3
    assert all(0 <= r[c] <= 1 for r in got for c in (*T.CATEGORIES, "score"))
    truth = {r[0]: r[2] for r in data}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert not [r for r in got if r["doc_id"] in (None, 1000) and r["predicted"]]


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0), (3, 0)]])
def test_without_positive_labels(spark, labels):
    docs = spark.createDataFrame(rows(20), DOCS)
    got = T.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 20


def test_empty(spark):
    assert T.toxicity_scores(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
