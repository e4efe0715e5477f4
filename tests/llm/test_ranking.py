import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import ranking
from tablewright.llm.texts import slices

DOCS = "doc_id long, text string, item_id long, score long, part int"
ITEMS = "item_id long, text string, doc_id int, n int, item int"
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    split = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 75 + 25 * sum(c.values()) * N // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, 2**63 - 1 if i is None else i))
        out += [(item, r + 1, None if i == 2**63 - 1 else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    common = ["the", "Of", "a", "und", "ÄÖ", "x1"]
    rare = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    docs = [(i * 37 % 1000, rng.choice([" ", "-", "\n", "_"]).join(word() for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(n)]
    docs += [(2000 + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (None, docs[6][1]), (7, docs[5][1]), (7, docs[5][1])]
    docs += [(3000, None), (3001, ""), (3002, " -_ \x00"), (3003, "the " * 5000)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 30])))) for i in range(25)]
    return docs, items + [(90, docs[5][1]), (91, None), (92, ""), (93, "nowhere"), (None, "the W5"), (5, "w9 w9 W9"), (5, "w9 w9 W9"), (94, "the")]


@pytest.mark.parametrize(("seed", "segment", "postings", "together"), [(0, 16_384, 500_000, 500_000), (1, 50, 300, 60)])
def test_like_scoring_every_document(spark, seed, segment, postings, together):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS).repartition(4)
    asked = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], ITEMS)
    got = ranking.ranked(df, asked, most_terms=together, segment_docs=segment, segment_postings=postings).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def segment(docs, items):
    """One segment over all documents, built without Spark."""
    known = ranking.asked(items)
    lists, sizes, df = {}, [], Counter()
    for place, (_, text) in enumerate(docs):
        part = next(slices(pa.array([text])))
        lowered, found = ranking._terms(part)
        sizes.append(len(found.starts))
        _, numbers = known.places(ranking.word_hashes(lowered.data, found), lowered, found)
        for t, n in Counter(numbers.tolist()).items():
            lists.setdefault(t, []).append((place, n))
            df[t] += 1
    order = sorted(lists)
    row = {
        "ids": np.array([i for i, _ in docs], "<i8").tobytes(),
        "sizes": np.array(sizes, "<i8").tobytes(),
        "term": np.array(order, "<i4").tobytes(),
        "length": np.array([len(lists[t]) for t in order], "<i4").tobytes(),
        "doc": np.array([d for t in order for d, _ in lists[t]], "<i4").tobytes(),
        "tf": np.array([n for t in order for _, n in lists[t]], "<i4").tobytes(),
    }
    weights = np.array([ranking.weight(len(docs), df[t]) for t in range(len(known))])
    return known, ranking.Segment(row, len(docs), sum(sizes), weights)


def test_blocks_are_left_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 16)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(1000)]
    docs += [(1000 + i, "rare " * 5 + "a b") for i in range(10)]
    known, built = segment(docs, [(0, "rare a b c")])
    terms, times = known.wanted[0]
    scores, ids = built.top(terms, times, 5, 1)
    assert [(0, r + 1, int(i), int(s)) for r, (s, i) in enumerate(zip(scores, ids, strict=True))] == brute(docs, [(0, "rare a b c")], 5)
    looked_at = []
    monkeypatch.setattr(ranking.np, "searchsorted", lambda a, v, *x, f=np.searchsorted: looked_at.append(len(v)) or f(a, v, *x))
    built.top(terms, times, 5, 1)
    assert sum(looked_at) < 500  # of 3,030 postings of the long lists


def test_sizes_beyond_64_bits_are_exact():
    row = {c: np.zeros(0, "<i4").tobytes() for c in ("term", "length", "doc", "tf")}
    row |= {"ids": np.array([1], "<i8").tobytes(), "sizes": np.array([2**40], "<i8").tobytes()}
    assert ranking.Segment(row, 2**30, 2**50, np.zeros(1, np.int64)).blocks == 1


def test_a_very_long_text_and_no_rows(spark):
    docs = [(1, "needle " + "straw " * 200_000), (2, "needle in straw")]
    df = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(1, "needle", 1, 1, 1)], ITEMS)
    assert sorted(map(tuple, ranking.ranked(df, asked).collect())) == brute(docs, [(1, "needle")])
    assert ranking.ranked(df.limit(0), asked).collect() == []
    assert ranking.ranked(df, asked.limit(0)).collect() == []
