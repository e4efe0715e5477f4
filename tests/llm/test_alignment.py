import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tablewright.llm import alignment
from tablewright.llm.texts import slices

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, block int, code string, links string, pairs int"


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    """By the libraries themselves, whole text by whole text, and by comparing offsets."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def spelled(piece):
        if piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = b = []
        if text:
            a = [(t, bytes(symbols[c] for c in one.id_to_token(t))) for t in one.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, spelled(other.id_to_piece(t))) for t in other.encode(text)]
            whole = (" " + text).encode()
            if b"".join(r for _, r in a) != whole or b"".join(r for _, r in b) != whole:
                a = b = []
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in cuts:
            groups.append(([t for t, s, e in a if low <= s and e <= high], [t for t, s, e in b if low <= s and e <= high]))
            low = high
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        docs.append((i, len(a), len(b), groups, links))
    count = Counter(pair for *_, links in docs for pair in set(links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = "the of résumé naïve 東京 вода tokenizer 12345 ====== ababababab don't ﬁ é <|endoftext|> <s> <unk> x　y \U0001f600".split(" ")
    gaps = [" ", " ", "  ", "\n", "\t", "    ", "\r\n", " \n "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([1, 2, 30, 120])))) for i in range(60)]
    odd = [None, "", " ", "   ", "▁", "a▁b", "\x00", "a\x00b", "\n", " a", "a ", "<0x41>", "�", "q" * 300]
    return rows + [(100 + i, t) for i, t in enumerate(odd)] + [(None, rows[2][1]), (None, None), (3, rows[4][1]), (3, rows[4][1])]


@pytest.mark.parametrize(("seed", "most_pairs", "most_docs"), [(0, 1_000_000, 4096), (1, 50, 7)])
def test_like_the_libraries_on_whole_texts(spark, seed, most_pairs, most_docs):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "c", "l", 2) for i, t in rows], DOCS).repartition(3)
    got = alignment.alignment(df, BYTES, PIECES, most_pairs, most_docs)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chunks_give_the_ids_of_whole_texts():
    one, other = alignment.ByteTokens(BYTES), alignment.PieceTokens(PIECES)
    assert other.cuts
    texts = [t for _, t in corpus(2) if t]
    for part in slices(pa.array(texts)):
        ids, counts = other.chunk_ids(alignment._spaced(part))
        assert np.split(ids, np.cumsum(counts)[:-1])[5].tolist() == other.model.encode(texts[part.first + 5])
        assert ids.tolist() == [i for t in texts[part.first : part.first + len(part)] for i in other.model.encode(t)]
    assert one.specials == []


def test_large_groups_by_distinct_ids(monkeypatch):
    one, other = alignment.ByteTokens(BYTES), alignment.PieceTokens(PIECES)
    part = next(slices(pa.array(["=" * 333 + "ab" * 200, "x" * 1000])))
    whole = alignment.aligned(part, one, other)
    monkeypatch.setattr(alignment, "SMALL_GROUP", 0)
    again = alignment.aligned(part, one, other)
    for name in ("owner", "code", "times", "n_links", "n_groups"):
        assert np.array_equal(whole[name], again[name])
    assert whole["n_links"].sum() == whole["times"].sum()


def test_coalescing():
    starts, ends = np.array([0, 2, 5, 0, 3, 5, 6]), np.array([2, 5, 9, 3, 5, 6, 9])
    order, group = alignment.coalesced(starts, ends, np.array([0, 0, 0, 1, 1, 1, 1]))
    assert group[np.argsort(order)].tolist() == [0, 0, 1, 0, 0, 1, 1]


def test_a_very_long_text_and_no_rows(spark):
    text = "word and tokenizer " * 30_000
    df = spark.createDataFrame([(1, text, 1, "", "", 1), (2, "word and", 1, "", "", 1)], DOCS)
    got = {r["doc_id"]: r for r in alignment.alignment(df, BYTES, PIECES).collect()}
    assert got[1]["n_a"] == len(alignment.ByteTokens(BYTES).tokenizer.encode(" " + text, add_special_tokens=False).ids)
    assert got[1]["n_links"] >= got[1]["n_groups"] > 80_000
    assert alignment.alignment(spark.createDataFrame([], DOCS), BYTES, PIECES).collect() == []
