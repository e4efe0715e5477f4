import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from tablewright.llm import catalogue, packing
from tablewright.llm.texts import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids int, start string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts, limit):
    out = []
    for part in slices(pa.array(texts, pa.string()), limit):
        ids, counts = encoder.chunk_ids(part)
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("special", [False, True])
def test_ids_are_those_of_the_whole_text(tokenizer, special):
    import random

    rng = random.Random(7)
    pieces = [" ", "  ", "\n", "\t", "a", "B", "9", "'s", "'", "é", " ", " ", "　", "中", "!", "😀", "\x1c", "\x85", "_", ".", "the"]
    pieces += ["<|endoftext|>"] if special else []
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "a  ", "  a"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(packing.Encoder(PATH), texts, 2000) == want


def test_a_full_memory_starts_afresh(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    texts = ["one two three four", "five six one two", "seven one"]
    assert ids_of(packing.Encoder(PATH), texts, 5) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_without_a_ranked_vocabulary(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_ranked", lambda _: None)
    texts = ["one two  three", "", "x y\n z"]
    assert ids_of(packing.Encoder(PATH), texts, 99) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 37])
def test_binary_lengths(n):
    got = packing.binary_lengths(n, 8)
    assert sum(got) == n
    assert all(x & (x - 1) == 0 and x <= 8 for x in got)
    assert got == sorted(got, reverse=True)
    assert len([x for x in got if x < 8]) == len({x for x in got if x < 8})


def test_pack(spark, tokenizer):
    rows = [(3, "hello world " * 40), (1, None), (2, ""), (None, "no id"), (3, "same id, other text"), (9, "x" * 9000), (4, "a b"), (4, "a b")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], DOCS).repartition(3)
    got = packing.pack(df, PATH, most=32).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 32 and r["offset"] == 0 for r in got)
    assert [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in got), reverse=True)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    want = sorted((i if i is not None else -1, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    pieces = {}
    for r in sorted(got, key=lambda r: (r["start"], r["sequence_id"])):
        pieces.setdefault((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]), []).append(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    for (_, n), own in pieces.items():
        assert sum(map(len, own)) % n == 0
    for i, ids in want:
        if [w for w, _ in want].count(i) == 1:
            assert [x for p in pieces[i, len(ids)] for x in p] == ids


def test_empty_and_bad_length(spark):
    df = spark.createDataFrame([], DOCS)
    assert packing.pack(df, PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, PATH, most=100)


def test_the_query_writes_the_sequences_themselves(spark):
    found = catalogue.op7_packing(spark, "/root/testdata/sf0.001")
    pieces = spark.read.parquet(*found.inputFiles()).select("ids", "length", "ids_crc32").collect()
    assert len(pieces) == found.count() > 0
    assert all(r["ids"] is not None and (len(r["ids"]), zlib.crc32(r["ids"])) == (4 * r["length"], r["ids_crc32"]) for r in pieces)


def test_numbers_do_not_depend_on_the_way_they_are_joined(spark, monkeypatch):
    rows = [(i, "hello world " * (i % 50), 0, "") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)

    def numbered():
        return sorted((r["sequence_id"], r["length"], r["ids_crc32"]) for r in packing.pack(df, PATH, most=32).collect())

    sent = numbered()
    monkeypatch.setattr(packing, "MOST_SENT", 0)
    assert numbered() == sent
    assert [n for n, _, _ in sent] == list(range(len(sent)))
