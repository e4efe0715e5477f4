import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablewright.llm import simhash
from tablewright.llm.components import components
from tablewright.llm.texts import slices

DOCS = "doc_id long, text string, source string, fp int"  # fp clashes with a name of the operator


def plain_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word], "") if word else (words, "")
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] if word else []
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, keys, most=3):
    """The smallest key reachable from each value."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    low = {}
    for r, k in zip(root, keys, strict=True):
        low[r] = min(low.get(r, k), k)
    return [low[r] for r in root]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("text", ["", "one", "One TWO", "a b c", "A\tb\n\nc  d É", "Ünï x y z " * 300, " lead and trail "])
def test_fingerprints(text):
    (part,) = slices(pa.array([text]))
    assert simhash.simhashes(part).tolist() == [plain_fingerprint(text)]


def test_fingerprints_of_many_texts():
    texts = ["", "x y", None, "same same same same", "", "the end of it all", ""]
    got = np.concatenate([simhash.simhashes(p) for p in slices(pa.array(texts), 9)]).tolist()
    assert got == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_links_close_over_all_near_pairs(spark, seed):
    rng = random.Random(seed)
    values = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12, 40])):
            values.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    values |= {7 ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # dense: every pair is near a third
    values = sorted(values)
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    assert links.count() <= 10 * len(values)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    keys = [signed(v) for v in values]
    assert [roots.get(k, k) for k in keys] == brute_roots(values, keys)


def test_whole_groups_count_as_one_link():
    fps = np.array(sorted({1 << a for a in range(3)} | set(range(8))), np.uint64)
    order = np.argsort(simhash.gray_rank(fps))
    found = list(simhash.GrayIndex(fps[order], np.array([0])).links(3))
    assert sum(len(a) for a, _ in found) <= len(fps)


def test_near_groups(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (9, base + " more"), (3, base), (None, None), (4, ""), (8, " \n"), (2, "other text"), (2, "other text"), (None, "alone at last")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)
    got = sorted(((r[0], r[1]), r[2]) for r in ((x["doc_id"] or -1, x["fp"], x["component_id"]) for x in simhash.near_groups(df).collect()))
    prints = [plain_fingerprint(t) for _, t in rows]
    lows = brute_roots(prints, [2**63 - 1 if i is None else i for i, _ in rows])
    want = sorted(((i or -1, signed(p)), None if low == 2**63 - 1 else low) for (i, _), p, low in zip(rows, prints, lows, strict=True))
    assert got == want


def test_one_document_of_each_group_stays_as_it_was(spark):
    base = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(3, base, "a", 1), (1, base, "b", 2), (1, base, "b", 2), (7, "else", None, 3)], DOCS)
    assert sorted(map(tuple, simhash.distinct_documents(df).collect())) == [(1, base, "b", 2), (7, "else", None, 3)]


def test_groups_without_an_id_of_their_own_keep_a_document_each(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(200)) for c in "abcd")
    rows = [(None, one), (None, two), (None, two), (None, None), (4, three), (4, four), (6, three), (7, four)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.distinct_documents(df).collect()))
    assert got == [(0, ""), (0, one), (0, two), (4, three), (4, four)]


def test_empty(spark):
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 8), (3, 2), (20, 30), (30, 40), (40, 50), (50, 60), (60, 20)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), *[(k, 20) for k in (20, 30, 40, 50, 60)]]


def near_copies(n, seed=5):
    rng = np.random.default_rng(seed)
    base, bits = np.uint64(0x9E3779B97F4A7C15), set()
    while len(bits) < n:
        bits.add(tuple(sorted(rng.choice(52, rng.integers(1, 4), replace=False).tolist())))
    fps = np.array([base ^ np.uint64(sum(1 << b for b in x)) for x in bits], np.uint64)
    return fps[np.argsort(simhash.gray_rank(fps))]


def test_many_near_copies_take_bounded_memory_and_few_links():
    fps = near_copies(8_000)
    index = simhash.GrayIndex(fps, np.array([0]))
    tracemalloc.start()
    found = sum(len(a) for a, _ in index.links(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = sum(int((np.bitwise_count(fps ^ x) <= 3).sum()) - 1 for x in fps) // 2
    assert found < near / 5
    assert peak < 64 * 2**20
    assert set(index.label.tolist()) == {0}


def labels_of(fps):
    index = simhash.GrayIndex(fps, np.array([0]))
    for _ in index.links(3):
        pass
    return index.label.tolist()


@pytest.mark.parametrize("walked", [1, 7, 16_384])
def test_labels_do_not_depend_on_how_much_is_opened_together(monkeypatch, walked):
    monkeypatch.setattr(simhash, "WALKED", walked)
    rng = np.random.default_rng(walked)
    other = rng.integers(0, 2**63, 60).astype(np.uint64)
    fps = np.unique(np.concatenate([near_copies(200), other, other ^ np.uint64(5), other ^ np.uint64(0x1F)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    assert labels_of(fps) == brute_roots([int(x) for x in fps], range(len(fps)))
