import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import search

ROWS = "vec_id long, embedding array<float>, v int, label int"


def brute(rows, every=50, k=5):
    good = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    asking = {}
    for i, v in good:
        if i % every == 0 and (i not in asking or v.tolist() < asking[i].tolist()):
            asking[i] = v
    out = []
    for i, q in asking.items():
        all_scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(all_scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "shard", "block"), [(0, 50_000, 10_000), (1, 90, 3)])
def test_like_brute_force(spark, seed, shard, block):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(700)]
    same = rng.normal(size=8).tolist()
    rows += [(1000 + i, same) for i in range(200)]  # equal vectors: ties, and a leaf that can't be split
    rows += [(50, rows[7][1]), (51, rows[7][1]), (2000, None), (2050, [1.0, None, 2.0]), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7)]
    rows += [(None, same), (3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3050, []), (-50, same)]
    df = spark.createDataFrame([(i, e, 1, 1) for i, e in rows], ROWS)
    got = search.nearest_embeddings(df, shard=shard, block=block).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)


def test_large_numbers_are_exact():
    vectors = np.array([[2**31, 1], [2**31, 2], [1, 1]], np.int64)
    found, scores, ids = search.BallTree(np.array([1, 2, 3]), vectors).top(np.array([9]), np.array([[2**31, 1]]), 2, np.array([np.iinfo(np.int64).min]))
    assert ids.tolist() == [[2, 1]]
    assert scores.tolist() == [[2**62 + 2, 2**62 + 1]]


def test_bounds_prune():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(20, 8)) * 1000
    vectors = np.concatenate([c + rng.normal(size=(200, 8)) for c in centers]).astype(np.int64)
    tree = search.BallTree(np.arange(len(vectors)), vectors)
    high = np.array([10**9])
    assert not tree.top(np.array([-1]), vectors[:1], 5, high)[0].any()


def test_scaling(spark):
    row = spark.sql("SELECT array(0.5D, -0.001D) a, array(1D, NULL) b, CAST(NULL AS array<double>) c, array(double('NaN')) d")
    got = row.select(*[search.scaled(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(got) == ([128, -1], None, None, None)


def test_empty(spark):
    assert search.nearest_embeddings(spark.createDataFrame([], ROWS)).collect() == []
