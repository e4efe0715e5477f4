import random
import zlib

import numpy as np
import pytest

from tablewright.llm import passages

DOCS = "doc_id long, text string, n_chars long, _id int"


def brute(rows, width):
    """doc_id -> (n_words, kept words), by comparing word windows themselves."""
    rank = lambda i: 2**63 - 1 if i is None else i
    split = [(rank(i), (t or "").split()) for i, t in rows]
    lowest = {}
    for i, ws in split:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            lowest[key] = min(lowest.get(key, i), i)
    out = []
    for (i, ws), (doc, _) in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(ws) - width + 1):
            if lowest[tuple(ws[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((doc, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzü")
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        ws = [word() for _ in range(rng.choice([0, 1, 9, 10, 11, 40, 200]))]
        if rng.random() < 0.5:
            a = rng.randint(0, 15)
            ws[len(ws) // 2 : len(ws) // 2] = passage[a : a + rng.randint(5, 15)]
        if rng.random() < 0.2:
            ws = ws + ws  # repeats inside one text are kept
        rows.append((i * 7 % 60, rng.choice([" ", "\n", "  ", "\t"]).join(ws)))
    rows += [(100 + i, rows[3][1]) for i in range(8)]
    return rows + [(None, rows[3][1]), (None, None), (200, ""), (201, None), (202, " \n "), (5, rows[9][1]), (5, rows[9][1])]


@pytest.mark.parametrize(("seed", "hot"), [(0, 4096), (1, 3)])
def test_like_comparing_words(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], DOCS).repartition(5)
    got = passages.kept_words(df, width=10, hot=hot).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 10)


def test_stage_keeps_columns_and_untouched_texts(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, shared + "\nend", 0, 9), (2, shared, 0, 9), (3, "head\t" + shared, 0, 9), (4, None, None, 9), (5, "a \n b", 5, 9)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: tuple(r) for r in passages.without_repeats(df).collect()}
    assert got == {1: rows[0], 3: (3, "head", 4, 9), 4: rows[3], 5: rows[4]}


@pytest.mark.parametrize("hot", [4096, 3])
def test_copies_under_one_id_share_a_list_no_longer_than_their_text(spark, hot):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, 0, text)] + [(9, 5, text + " " + text)] * 200
    got = passages.repeated_windows(spark.createDataFrame(rows, "id long, tag int, text string"), 10, hot).collect()
    assert [(r["id"], r["tag"], sorted(r["places"])) for r in got] == [(9, 5, [*range(21), *range(30, 51)])]


def equal_checksums():
    """Two texts of 60 words each, without a common window, whose CRC-32 is equal."""
    heads = [" ".join(f"{name}{i}" for i in range(59)) + " " for name in "ab"]
    rng = random.Random(0)
    ends = [f"{rng.getrandbits(48):x}" for _ in range(400_000)]
    seen = {zlib.crc32((heads[0] + e).encode()): e for e in ends}
    for e in ends:
        if (found := seen.get(zlib.crc32((heads[1] + e).encode()))) is not None:
            return heads[0] + found, heads[1] + e
    raise AssertionError


def test_texts_of_one_id_with_equal_checksums_stay_apart(spark):
    one, other = equal_checksums()
    long = one + " " + " ".join(f"c{i}" for i in range(300))
    for texts in ([one, other], [one, other, long]):
        rows = [(1, texts[-1] if len(texts) > 2 else one, 0, 0), *[(None, t, 0, 0) for t in texts]]
        got = passages.kept_words(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == brute([r[:2] for r in rows], 50)


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words), 0, 0), (2, " ".join(words[100:59_000]), 0, 0)]
    got = passages.kept_words(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_removed", "kept").collect()
    assert [(r[0], r[1]) for r in sorted(got)] == [(1, 0), (2, 58_900)]
    assert sorted(got)[1]["kept"] == ""


def test_empty(spark):
    assert passages.kept_words(spark.createDataFrame([], DOCS)).collect() == []


def test_sketch_never_underestimates(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(i, t or "", 0, 0) for i, t in rows], DOCS)
    sketch = passages.sketch_windows(df, 10)
    where = {}
    for i, (_, t) in enumerate(rows):
        ws = (t or "").split()
        for k in range(len(ws) - 9):
            where.setdefault(" ".join(ws[k : k + 10]), set()).add(i)
    repeated = [k for k, v in where.items() if len(v) > 1]
    assert repeated
    import pyarrow as pa

    for part in passages.slices(pa.array(repeated)):
        values, at, _ = passages._window_hashes(part, passages.words(part), 10)
        assert len(sketch.estimated_repeated(passages.span_hashes(values, at, at + 10))) == len(repeated)


def test_deltas():
    for cells in ([0], [0, 0, 1], [254, 255, 256, 5000, 5000], [255], [510, 765]):
        assert passages._from_deltas(passages._deltas(np.array(cells))).tolist() == cells


def test_a_worker_needs_little_memory_beside_its_batch():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 700))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), pa.array(texts)], names=["id", "tag", "text"])
    sketch = passages.Sketch(passages.MOST_BITS, passages.BLOCK_BITS, {})
    assert sum(m.nbytes for m in sketch._unpack()) <= 64 << 20
    for m in sketch._unpack():
        m[:] = 255

    def peak(found):
        tracemalloc.start()
        assert sum(1 for _ in found)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(passages._candidate_rows(iter([batch]), sketch, 50, False)) < 24 << 20
    assert peak(passages._sparse_cells(iter([batch] * 2), 50, passages.MOST_BITS, passages.BLOCK_BITS)) < 60 << 20
