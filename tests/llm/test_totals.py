import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, sharding
from tablewright.llm.totals import running_totals

DOCS = "doc_id long, text string, source string, size int, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n=300, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["one", "two", "drei", "é", "#$%"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, text, "hot" if i % 3 == 0 else rng.choice(["a", "b", "ü", "Z", None, "empty"]), 1, len(text)))
    rows = [(i, "" if s == "empty" else t, s, k, 0 if s == "empty" else n) for i, t, s, k, n in rows]
    return [*rows, (None, "null id here", "a", 1, 12), (None, None, None, 1, None), (5, "again", "b", 1, 5), (5, "again", "b", 1, 5)]


def test_running_totals(spark):
    rows = [(i % 17, i) for i in range(200)] + [(None, 3), (4, None)]
    df = spark.createDataFrame(rows, "k int, v int")
    got, totals = running_totals(df, [F.col("k"), F.col("v")], {"v": F.col("v"), "rows": F.lit(1)})
    assert totals == {"v": sum(v or 0 for _, v in rows), "rows": 202}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    want, so_far = [], 0
    for n, (k, v) in enumerate(ordered):
        want.append((k, v, so_far, n))
        so_far += v or 0
    assert [tuple(r) for r in sorted(got.collect(), key=lambda r: r["before_rows"])] == want
    nothing, zero = running_totals(df.limit(0), [F.col("k")], {"v": F.col("v")})
    assert nothing.collect() == []
    assert zero == {"v": 0}


def test_shards(spark):
    rows = documents()
    got = sharding.byte_shards(spark.createDataFrame(rows, DOCS).repartition(4), 8).collect()
    sizes = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sizes
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert ids == sorted(ids)
    by_shard = defaultdict(list)
    for r in ordered:
        by_shard[r["shard"]].append(r)
    assert all([r["slot"] for r in own] == list(range(len(own))) for own in by_shard.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert set(by_shard) == set(range(8))
    assert all(abs(sum(r["size"] for r in own) - total / 8) <= largest for own in by_shard.values())


@pytest.mark.parametrize("n_shards", [1, 8, 50])
def test_shards_like_brute_force(spark, n_shards):
    rows = [*documents(120, seed=3), (60, "é" * 1_000_000, "a", 1, 0)]  # a very long text under a repeated id
    got = sharding.byte_shards(spark.createDataFrame(rows, DOCS).repartition(5), n_shards).collect()
    facts = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows]
    facts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, slots, want = sum(r[2] for r in facts), 0, Counter(), []
    for i, crc, size in facts:
        shard = min(n_shards - 1, n_shards * (2 * before + size) // (2 * total))
        want.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    assert sorted(map(tuple, got), key=lambda r: (r[3], r[4])) == want


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "x" * 100, "", 0, 0), (2, "", "", 0, 0)], DOCS)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.byte_shards(df, 8).collect()} == {1: (3, 0), 2: (7, 0)}
    assert sharding.byte_shards(df.limit(0), 8).collect() == []
    with pytest.raises(ValueError):
        sharding.byte_shards(df, 0)


def brute_targets(sizes, share=1.5, most=2):
    """Shares by weight; what is above a source's limit is dealt again to the rest, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, targets, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if per * weights[s] >= most * sizes[s]}
        if not full:
            return targets | {s: per * weights[s] for s in open_}
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ -= full
    return targets


def test_mix_plan(spark):
    rows = documents(seed=2)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mix_plan(df).collect()
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += len(WORD.findall(t or ""))
    targets = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in size)
    epochs = {s: int(targets[s] / size[s]) if size[s] else 0 for s in size}
    assert all(r["taken"] >= epochs[r["source"]] * r["size"] for r in got)
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_heavier_documents_are_taken_more_often(spark):
    text = {0: "word " * 9 + "x", 1: "w#$%##### " * 9 + "#"}
    rows = [(i, text[i % 2], "s" if i < 2000 else "t", 0, 0) for i in range(4000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, DOCS), weights=(1, 3), share=0.5)
    rate = {r["odd"]: r["t"] for r in plan.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).collect()}
    assert rate[0] > 1.5 * rate[1]


def test_mix_gives_what_the_plan_takes(spark):
    rows = documents(seed=3)
    df = spark.createDataFrame(rows, DOCS)
    plan, mixed = mixing.mix_plan(df).collect(), mixing.mix(df)
    assert mixed.columns == df.columns
    words = lambda t: len(WORD.findall(t or ""))
    want, got, texts = Counter(), Counter(), {(r[0], r[2]): r[1] for r in rows}
    for r in plan:
        want[r["doc_id"], r["source"]] += r["taken"]
    for r in mixed.collect():
        got[r["doc_id"], r["source"]] += words(r["text"])
        whole = texts[r["doc_id"], r["source"]]
        assert r["text"] == whole or whole.split()[: words(r["text"])] == r["text"].split()
        assert r["n_chars"] == len(r["text"])
    assert +got == +want


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix_plan(df).collect() == []
    assert mixing.mix(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a", 0, 0), (2, " ", None, 0, 0)], DOCS)
    assert [r["taken"] for r in mixing.mix_plan(blank).collect()] == [0, 0]
