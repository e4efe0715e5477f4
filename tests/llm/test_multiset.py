import hashlib

import numpy as np
import pytest
import xxhash

from tablewright.llm import multiset

DOCS = "doc_id long, text string, part int, id string"
WORDS = [f"word{i}" for i in range(3000)]


def brute(rows, in_order=False):
    """Rows as the contract states them, without the likenesses."""
    ordered = rows if in_order else sorted(rows, key=lambda r: (2**63 if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        like = [multiset.likeness(multiset._arrays([t]), multiset._arrays([x]))[0] for x in (changed, after)]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), multiset.fingerprint(t).hex(), multiset.fingerprint(changed).hex(), *like))
    return out


def test_order_of_paragraphs_and_blank_lines_do_not_matter():
    assert multiset.fingerprint("a b\nc d e f g h\n\nx") == multiset.fingerprint("x\nc d e f g h\na b")
    assert multiset.fingerprint("a b\na b") != multiset.fingerprint("a b")
    assert multiset.fingerprint("a b\nc") != multiset.fingerprint("a\nb c")
    assert multiset.fingerprint(None) == multiset.fingerprint("") == multiset.fingerprint("\n\n") == bytes(multiset.BYTES)


def test_insertion_and_deletion():
    whole = multiset.fingerprint("one two three\nfour five\nsix")
    assert multiset.inserted(multiset.fingerprint("six\none two three"), "four five") == whole
    assert multiset.deleted(whole, "four five\nsix") == multiset.fingerprint("one two three")
    assert multiset.deleted(whole, "six\none two three\nfour five") == bytes(multiset.BYTES)


def test_a_slice_is_like_its_texts_one_by_one():
    texts = ["", "a\nb", None, "\n", "x y z " * 40 + "\nend", "ü\n\nü", "tail\n"]
    import pyarrow as pa

    got = [b for p in multiset.slices(pa.array(texts), 30) for b in multiset.packed(*multiset.fingerprint_arrays(p))]
    assert got == [multiset.fingerprint(t) for t in texts]


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(30):
        a = [" ".join(rng.choice(WORDS, 12)) for _ in range(40)]
        b = [" ".join(rng.choice(WORDS, 12)) for _ in range(40)]
        found.append([multiset.likeness(multiset._arrays(["\n".join(a)]), multiset._arrays(["\n".join(a[:k] + b[k:])]))[0] for k in (0, 20, 30, 40)])
    none, half, most, same = np.array(found).mean(axis=0)
    assert none < 0.15
    assert half == pytest.approx(0.5, abs=0.08)
    assert most == pytest.approx(0.75, abs=0.06)
    assert same == 1


@pytest.mark.parametrize("per_task", [5_000, 4])
def test_like_brute_force(spark, per_task):
    rows = [(i * 3 % 41, " ".join(WORDS[i : i + 3 * i]) + "\nü" * (i % 3)) for i in range(41)]
    rows += [(None, "null id"), (None, None), (7, "again"), (7, "again"), (20, None), (20, ""), (-5, "first of all, and long enough to lend")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS).repartition(5)
    got = [tuple(r) for r in multiset.edit_likeness(df, per_task).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_one_document_and_none(spark):
    (row,) = multiset.edit_likeness(spark.createDataFrame([(4, "abcdefgh", 0, "")], DOCS)).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert row["near_next"] == 1
    assert multiset.edit_likeness(spark.createDataFrame([], DOCS)).collect() == []


def place(text):
    """Where the rows of a frequent id stand: by the upper bits of XXH64 with seed 42, then by text."""
    return xxhash.xxh64_intdigest((text or "").encode(), 42) >> (64 - multiset.TIE_BITS), text or ""


@pytest.mark.parametrize("hot", [None, 3, -9])
def test_rows_of_a_frequent_id_are_split(spark, hot):
    own = [(hot, f"text number {i} of many that share an id\n{i % 7}") for i in range(300)]
    copies = [(hot, "the same text again")] * 400 + [(hot, None)] * 100
    rows = own + copies + [(i, f"other {i}") for i in range(0, 40, 2)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS).repartition(7)
    found = multiset.edit_likeness(df, 20)
    got = [tuple(r) for r in found.collect()]
    ordered = sorted(rows, key=lambda r: (2**63 if r[0] is None else r[0], place(r[1]) if r[0] == hot else (0, r[1])))
    assert sorted(got, key=repr) == sorted(brute(ordered, in_order=True), key=repr)
    sizes = [r["count"] for r in found.groupBy(multiset.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 100


def test_many_null_ids_spread_over_tasks(spark):
    df = spark.range(100_000).selectExpr("cast(null as long) doc_id", "if(id % 2 = 0, null, concat('t', id)) text")
    per_task = multiset.edit_likeness(df).groupBy(multiset.F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 100_000
    assert max(r["count"] for r in per_task) < 3 * multiset.PER_TASK


def plain_fingerprint(text):
    """The definition paragraph by paragraph, from Python integers alone but for the mixing of one hash."""
    exact, lanes = [0] * multiset.EXACT, [0] * multiset.LANES
    for paragraph in filter(None, text.split("\n")):
        a, b = multiset._parts(multiset.fingerprint(paragraph))
        exact = [(x + int(y)) % 2**64 for x, y in zip(exact, a, strict=True)]
        lanes = [x + int(y) for x, y in zip(lanes, b, strict=True)]
        shingles = max(len(paragraph.split()) - multiset.SHINGLE + 1, min(len(paragraph.split()), 1))
        assert all(abs(int(y)) <= shingles and (int(y) - shingles) % 2 == 0 for y in b)
    return b"".join(x.to_bytes(8, "little") for x in exact) + b"".join((x % 2**16).to_bytes(2, "little") for x in lanes)


def test_sums_of_paragraphs_in_plain_integers():
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = "\n".join(" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(rng.integers(1, 60)))
        assert multiset.fingerprint(text) == plain_fingerprint(text)
