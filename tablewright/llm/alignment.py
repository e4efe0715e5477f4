"""Tokens of two tokenizers over the same bytes, coalesced to groups, with corpus counts of linked ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.packing import REMEMBERED, Encoder
from tablewright.llm.shared import pick, written
from tablewright.llm.texts import _BYTES, Slice, slices, span_hashes, within

_SPACE = "▁"  # how a piece writes a space
#: Linked pairs and documents of a block, the unit whose pairs are counted together.
BLOCK_PAIRS = 1_000_000
BLOCK_DOCS = 4096
#: Occurrence pairs up to which a group is expanded as it stands; larger ones by their distinct ids.
SMALL_GROUP = 4096


class Spelling:
    """The bytes of every id of a vocabulary, in one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.width[ids]
        return self.data[np.repeat(self.first[ids], size) + within(size)]

    def spells(self, ids: np.ndarray, counts: np.ndarray, text: Slice) -> np.ndarray:
        """For every text, whether its ids' bytes are the text's."""
        reached = np.r_[0, np.cumsum(self.width[ids])][np.r_[0, np.cumsum(counts)]]
        sizes = np.diff(text.offsets)
        right = np.diff(reached) == sizes
        some = np.repeat(right, counts)
        same = self.of(ids[some]) == text.data[np.repeat(right, sizes)]
        owner = np.flatnonzero(right)
        wrong = np.searchsorted(np.cumsum(sizes[right]), np.flatnonzero(~same), "right")
        right[owner[wrong]] = False
        return right


class ByteTokens(Encoder):
    """A byte-level tokenizer for which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.specials = []
        # Fixed rule of byte-level vocabularies: visible bytes stand for themselves, the others follow from 256.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        symbols = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        tokens = [b""] * len(self.width)
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(symbols[c] for c in token if c in symbols)
        self.spelling = Spelling(tokens)


class PieceTokens:
    """A sentencepiece model that adds a space before a text, with remembered chunks.

    If no piece holds a space behind another character, merges never go from a character to a following
    space. Then a text may be cut before every run of spaces, and each chunk encoded by itself without its
    first space, which the model adds. Other models encode whole texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        tokens = [p.replace(_SPACE, " ").encode() for p in pieces]
        for i in range(n):
            if self.model.is_byte(i):
                tokens[i] = bytes([int(pieces[i][1:-1], 16)])
        self.spelling = Spelling(tokens)
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def chunk_ids(self, text: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each begin with the added space, and how many each text has."""
        data, offsets = text.data, text.offsets
        opens = (data == 32) & (np.r_[np.uint8(0), data[:-1]] != 32)
        opens[offsets[:-1]] = True
        starts = np.flatnonzero(opens)
        ends = np.r_[starts[1:], len(data)]
        raw = data.tobytes()
        h, g = span_hashes(_BYTES[0][data], starts, ends, 0), span_hashes(_BYTES[1][data], starts, ends, 1)
        keys, where, turn = np.unique(h, return_index=True, return_inverse=True)
        checks = g[where]
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not self.cuts or (checks[turn] != g).any() or (self.checks[at[known]] != checks[known]).any():
            each = self._encode([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.int64), *each]), np.array([len(e) for e in each], np.int64)
        place = np.empty(len(keys), np.int64)
        place[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            spans = where[new]
            each = self._encode([raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            place[new] = len(self.first) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, *each])
            self.first = np.r_[self.first, self.first[-1] + np.cumsum([len(e) for e in each])]
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.checks = np.insert(self.checks, at[new], checks[new])
            self.places = np.insert(self.places, at[new], place[new])
        chunk = place[turn]
        sizes = self.first[chunk + 1] - self.first[chunk]
        totals = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.repeat(self.first[chunk], sizes) + within(sizes)]
        return ids, np.diff(totals[np.searchsorted(starts, offsets)])

    def _encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        found = self.model.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
        alone = [self.model.piece_to_id(_SPACE)]  # nothing is added before nothing
        return [np.array(ids if len(c) > 1 else alone, np.int64) for c, ids in zip(chunks, found, strict=True)]


@lru_cache(maxsize=2)
def _tokens(byte_path: str, piece_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(byte_path), PieceTokens(piece_path)


@lru_cache(maxsize=2)
def _decimals(n: int) -> Spelling:
    return Spelling([b"%d" % i for i in range(n)])


def coalesced(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens by rising start, and the group of each in that order: a group ends where a start reaches
    the largest end so far."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.r_[True, starts[order][1:] >= reach[:-1]][: len(order)]
    return order, np.cumsum(opens) - 1


def _spaced(part: Slice) -> Slice:
    n, sizes = len(part), np.diff(part.offsets)
    data = np.full(len(part.data) + n, 32, np.uint8)
    data[np.arange(len(part.data)) + np.repeat(np.arange(1, n + 1), sizes)] = part.data
    return Slice(part.first, data, part.offsets + np.arange(n + 1))


def _pairs(group_a: np.ndarray, group_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, group and number of occurrences of the linked pairs; both sides lie group by group, and every
    group has tokens of both. Small groups are expanded token by token, large ones by distinct ids."""
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    small = n_a * n_b <= SMALL_GROUP
    first_b = np.cumsum(n_b) - n_b
    own = np.flatnonzero(small[group_a])
    fan = n_b[group_a[own]]
    left = np.repeat(own, fan)
    out = [(a[left], b[np.repeat(first_b[group_a[own]], fan) + within(fan)], group_a[left], np.ones(len(left), np.int64))]
    first_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(~small).tolist():
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        some = np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a))
        out.append((*some, np.full(len(some[0]), g), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def aligned(part: Slice, one: ByteTokens, other: PieceTokens) -> dict[str, np.ndarray | list]:
    """Per text of a slice n_a, n_b, n_groups, n_links and groups_sha256; and over all of them the distinct
    linked pairs: owner (text), code (first id << 32 | second id), times."""
    n = len(part)
    text = _spaced(part)
    (a, n_a), (b, n_b) = one.chunk_ids(text), other.chunk_ids(text)
    a = a.astype(np.int64)
    good = (np.diff(part.offsets) > 0) & one.spelling.spells(a, n_a, text) & other.spelling.spells(b, n_b, text)
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    sizes = np.where(good, np.diff(text.offsets), 0)

    width = np.r_[one.spelling.width[a], other.spelling.width[b]]
    end = np.r_[np.cumsum(width[: len(a)]), np.cumsum(width[len(a) :])]
    side = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
    order, group = coalesced(end - width, end, side)
    groups = int(group[-1]) + 1 if len(group) else 0
    token_group = np.empty(len(group), np.int64)
    token_group[order] = group
    last = np.zeros(groups, np.int64)
    np.maximum.at(last, token_group, end)
    owner = np.searchsorted(np.cumsum(sizes), last, "left")

    pair_a, pair_b, pair_group, times = _pairs(token_group[: len(a)], token_group[len(a) :], a, b)
    codes = pair_a * len(other.spelling.width) + pair_b
    keys = owner[pair_group] * (len(one.spelling.width) * len(other.spelling.width)) + codes
    turn = np.argsort(keys, kind="stable")
    distinct = np.flatnonzero(np.diff(keys[turn], prepend=-1))
    total = np.add.reduceat(times[turn], distinct) if len(turn) else times
    kept = turn[distinct]
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, owner[pair_group], times)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(owner, minlength=n),
        "n_links": n_links,
        "groups_sha256": _digests(np.r_[a, b], token_group, side, owner, good),
        "owner": owner[pair_group[kept]],
        "code": (pair_a[kept] << 32) | pair_b[kept],
        "times": total,
    }


def _digests(ids: np.ndarray, group: np.ndarray, side: np.ndarray, owner: np.ndarray, good: np.ndarray) -> list[str]:
    """SHA-256 of every text's groups, written ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    if not len(ids):
        return [""] * len(good)
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = ids[order], group[order], side[order]
    after = np.full(len(ids), ord(","), np.uint8)
    after[:-1][side[1:] != side[:-1]] = ord("|")
    after[:-1][group[1:] != group[:-1]] = ord(";")
    decimals = _decimals(1 << int(ids.max()).bit_length())
    size = decimals.width[ids]
    ends = np.cumsum(size + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    out[np.repeat(ends - size - 1, size) + within(size)] = decimals.of(ids)
    out[ends - 1] = after
    text = owner[group]
    raw, done = out.tobytes(), [""] * len(good)
    lasts = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    begin = 0
    for t, stop in zip(text[lasts].tolist(), ends[lasts].tolist(), strict=True):
        done[t] = hashlib.sha256(raw[begin : stop - 1]).hexdigest()
        begin = stop
    return done


_STORED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, more binary, pairs binary"
_DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, most_pairs: int, most_docs: int) -> DataFrame:
    """A row per document, and a row per block with the distinct pairs of its documents.

    ``links`` are a document's pairs as steps between their places in the block's list, ``more`` the places
    (among the document's own) and numbers of those that come more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = _tokens(byte_path, piece_path)
        names = [c.split(" ")[0] for c in _STORED.split(", ")]
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            counts = np.concatenate([np.bincount(x["owner"], minlength=len(x["n_a"])) for x in held])
            code, turn, docs_with = np.unique(np.concatenate([x["code"] for x in held]), return_inverse=True, return_counts=True)
            times = np.concatenate([x["times"] for x in held])
            own = pa.concat_arrays(ids)
            starts = np.r_[0, np.cumsum(counts)]
            links, more = [], []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                links.append(np.diff(turn[low:high], prepend=0).astype("<u4").tobytes())
                often = np.flatnonzero(times[low:high] > 1)
                more.append(np.stack([often, times[low:high][often]]).astype("<i8").tobytes())
            block = pa.array(np.full(len(counts), base + number, np.int64))
            numbers = [pa.array(np.concatenate([x[c] for x in held]), pa.int64()) for c in _DIGEST[1:]]
            shas = pa.array([s for x in held for s in x["groups_sha256"]], pa.string())
            columns = [block, own, *numbers, shas, pa.array(links, pa.binary()), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(counts), pa.binary())], names=names)
            pairs = code.astype("<i8").tobytes() + docs_with.astype("<i4").tobytes()
            lone = [pa.array([base + number], pa.int64()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays([*lone, pa.array([pairs], pa.binary())], names=names)
            number += 1
            ids.clear()
            held.clear()

        for batch in batches:
            for part in slices(batch["text"]):
                held.append(aligned(part, one, other))
                ids.append(batch["doc_id"].slice(part.first, len(part)))
                if sum(len(x["code"]) for x in held) >= most_pairs or sum(map(len, ids)) >= most_docs:
                    yield from flush()
        if held:
            yield from flush()

    return pick(docs, doc_id="long", text="string").mapInArrow(run, _STORED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, code, docs of the packed pairs of blocks."""
    for batch in batches:
        for block, raw in zip(batch["block"].to_pylist(), batch["pairs"], strict=True):
            whole = raw.as_buffer()
            n = whole.size // 12
            code = np.frombuffer(whole, "<i8", n)
            docs = np.frombuffer(whole, "<i4", n, 8 * n)
            columns = [pa.array(np.full(n, block, np.int64)), pa.array(code), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "code", "docs"])


def _summed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of one block, from its pairs' counts in the corpus."""
    turn = np.argsort(known["code"].to_numpy())
    count, best = known["count"].to_numpy()[turn], known["best"].to_numpy()[turn]
    n_best, count_sum = [], []
    for links, more in zip(docs["links"].to_pylist(), docs["more"].to_pylist(), strict=True):
        at = np.cumsum(np.frombuffer(links, "<u4").astype(np.int64))
        times = np.ones(len(at), np.int64)
        often, how = np.frombuffer(more, "<i8").reshape(2, -1)
        times[often] = how
        n_best.append(int(times[count[at] == best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    out = docs.select([*_DIGEST, "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def alignment(docs: DataFrame, byte_path: str, piece_path: str, most_pairs: int = BLOCK_PAIRS, most_docs: int = BLOCK_DOCS) -> DataFrame:
    """How the tokens of two tokenizers lie over each other, per document: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, n_best, count_sum.

    A is the byte-level tokenizer over a space and the text, B the sentencepiece model, which adds the space.
    Both cover the same bytes; the tokens of a slice of texts are sorted by start, and a group ends where a
    start reaches the largest end so far, that is where A and B tokens both end. All A-B pairs of a group are
    links. A pair of ids counts the documents that hold it linked; ``n_best`` are the links whose pair has
    the highest count of its A id, ``count_sum`` adds the counts of all links.

    Texts that are null, empty, or not spelled by the tokens of A or B have no tokens: zeros and ''. Null
    doc_ids stay null, rows with one doc_id are documents of their own, extra columns are ignored, an empty
    table has no rows. A text is taken whole; it is never split over blocks.

    Texts are tokenised once. Documents are gathered to blocks, and only the distinct pairs of a block, with
    the number of its documents, are shuffled to be counted; the counts come back to the block's documents.
    A task holds a block (``most_pairs`` pairs and ``most_docs`` documents, or the pairs of one more slice).
    The paths are files that every executor has.
    """
    stored = written(_blocks(docs, byte_path, piece_path, most_pairs, most_docs), "alignment")
    pairs = stored.filter("pairs IS NOT NULL").select("block", "pairs").mapInArrow(_unpacked, "block long, code long, docs int")
    counts = pairs.groupBy("code").agg(F.sum("docs").alias("count"))
    # An A id has at most as many pairs as B has ids.
    of_a = Window.partitionBy(F.shiftright("code", 32))
    known = pairs.join(counts.withColumn("best", F.max("count").over(of_a)), "code").select("block", "code", "count", "best")
    documents = stored.filter("pairs IS NULL").drop("pairs")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, schema)
