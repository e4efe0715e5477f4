import numpy as np
import pytest

from tablewright.llm import cosines

ROWS = "vec_id long, embedding array<float>, label int, rid long, bucket string, n int"


def brute(rows, least=0.93):
    """By comparing every two rows."""
    good = lambda e: e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    real = [np.array(e, np.float32).astype(float) if good(e) and label is not None else None for _, e, label in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = real[i], real[j]
            if x is None or y is None or rows[i][2] != rows[j][2] or len(x) != len(y):
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        low.setdefault(root(i), []).append(v)
    smallest = {r: min((v for v in vs if v is not None), default=None) for r, vs in low.items()}
    return sorted(((v, n[i], smallest[root(i)], v == smallest[root(i)]) for i, (v, _, _) in enumerate(rows)), key=repr)


def noisy(rng, center, cosine):
    """A vector at exactly this cosine (before rounding to float)."""
    away = rng.normal(size=len(center))
    away -= away @ center / (center @ center) * center
    unit = center / np.linalg.norm(center)
    return (cosine * unit + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)) * rng.uniform(0.5, 2)


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i * 7 % 400), rng.normal(size=16).tolist(), int(i % 3)) for i in range(250)]
    for k in range(20):
        center = rng.normal(size=16)
        rows += [(1000 + 10 * k + j, noisy(rng, center, rng.uniform(0.97, 1)).tolist(), k % 3) for j in range(6)]
    same = rng.normal(size=16).tolist()
    rows += [(3000 + i, same, 1) for i in range(60)] + [(4000, same, 2), (4001, same, None), (None, same, 1), (3000, same, 1)]
    rows += [(None, [5.0] * 16, 2), (None, [2.5] * 16, 2), (5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [1.0, None] * 8, 1)]
    rows += [(5004, [float("nan")] * 16, 1), (5005, [float("inf")] * 16, 1), (5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1), (5008, [-0.0] * 15 + [1.0], 0)]
    return rows + [(5009, [0.0] * 15 + [3.0], 0), (5010, [1e-30] * 16, 0), (5011, [1e30] * 16, 0), (None, None, None)]


@pytest.mark.parametrize(("seed", "together"), [(0, 4096), (1, 7)])
def test_like_comparing_all_rows(spark, seed, together):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, e, c, 1, "b", 2) for i, e, c in rows], ROWS).repartition(5)
    got = cosines.near_vectors(df, together=together).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    for size in (16, 64, 768):
        for cosine, least in ((0.93, 0.95), (0.95, 0.985), (0.98, 1.0)):
            x = rng.normal(size=(1500, size))
            y = np.stack([noisy(rng, c, cosine) for c in x])
            one, other = (cosines.bucket_keys(cosines.unit_vectors(z)) for z in (x, y))
            assert (one == other).any(axis=1).mean() >= least
        far = cosines.bucket_keys(cosines.unit_vectors(rng.normal(size=(1500, size))))
        assert (one == far).mean() < 0.001


def test_keys_are_the_same_in_any_batch():
    x = cosines.unit_vectors(np.random.default_rng(1).normal(size=(300, 64)))
    whole = cosines.bucket_keys(x)
    for rows in (slice(0, 1), slice(7, 12), slice(100, 300)):
        assert np.array_equal(cosines.bucket_keys(x[rows]), whole[rows])


def test_a_dense_bucket_gives_sums_and_a_forest(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    rows = [(i, noisy(rng, center, 0.999).tolist(), 1, 0, "", 0) for i in range(900)]
    for together in (4096, 100):
        got = cosines.near_vectors(spark.createDataFrame(rows, ROWS), together=together).collect()
        assert {(r["n_links"], r["component_id"]) for r in got} == {(899, 0)}
        assert [r["vec_id"] for r in got if r["kept"]] == [0]


def test_empty(spark):
    assert cosines.near_vectors(spark.createDataFrame([], ROWS)).collect() == []
