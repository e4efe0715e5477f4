"""Ranked lexical search over index segments: accumulators of short lists inside a document-at-a-time walk."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import pick, written
from tablewright.llm.texts import LOWER, Slice, slices, word_hashes, words

_U64 = np.uint64
#: Characters that separate terms: ASCII but for digits and letters.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[:128] = True
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Documents and postings of a segment, the unit that is searched at once.
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 500_000
#: Terms of the items that are asked together, repeats included, unless one item has more.
MOST_TERMS = 500_000
#: Documents between two block maxima of a list; lists up to one posting in so many documents are short.
BLOCK = 512
SHORT = 16


@dataclass
class Asked:
    """Items of one block: their distinct terms, by rising hash, and per item the terms with their repeats."""

    items: np.ndarray
    first: np.ndarray
    second: np.ndarray
    wanted: list[tuple[np.ndarray, np.ndarray]]

    def __len__(self) -> int:
        return len(self.first)

    def places(self, h: np.ndarray, part: Slice, found) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms with hashes h are asked for, and their numbers."""
        at = np.searchsorted(self.first, h)
        hit = np.flatnonzero(self.first[np.minimum(at, len(self) - 1)] == h) if len(self) else np.zeros(0, np.int64)
        if len(hit):  # settled by another 64 bits
            some = type(found)(found.starts[hit], found.ends[hit], found.first)
            hit = hit[word_hashes(part.data, some, 1) == self.second[at[hit]]]
        return hit, at[hit]


def _terms(part: Slice):
    lowered = Slice(part.first, LOWER[part.data], part.offsets)
    return lowered, words(lowered, NOT_TERM)


def asked(rows: list[tuple[int, str | None]]) -> Asked:
    """The terms of some items, given as (number, text)."""
    each = []
    for part in slices(pa.array([t for _, t in rows], pa.string())):
        lowered, found = _terms(part)
        pairs = np.stack([word_hashes(lowered.data, found), word_hashes(lowered.data, found, 1)])
        each += [pairs[:, a:b] for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]
    distinct, turn = np.unique(np.concatenate([np.zeros((2, 0), _U64), *each], axis=1), axis=1, return_inverse=True)
    ends = np.cumsum([p.shape[1] for p in each])
    wanted = [np.unique(turn.ravel()[e - p.shape[1] : e], return_counts=True) for p, e in zip(each, ends, strict=True)]
    return Asked(np.array([i for i, _ in rows], np.int64), distinct[0], distinct[1], wanted)


_SEGMENT = "docs long, terms long, ids binary, sizes binary, term binary, length binary, doc binary, tf binary"


def _segments(docs: DataFrame, sent: Broadcast, most_docs: int, most_postings: int) -> DataFrame:
    """Inverted lists of the asked terms, a row per segment: documents and terms counted, doc_ids and term
    counts of the documents in the lists, and list by list the documents (by place) and frequencies."""
    names = [c.split(" ")[0] for c in _SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Asked = sent.value
        counted, total, n_docs = 0, 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal counted, total, n_docs
            ids, sizes, doc, term, tf = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 5
            turn = np.argsort(term, kind="stable")  # documents stay in order
            term, length = np.unique(term[turn], return_counts=True)
            numbers = [ids, sizes, term, length, doc[turn], tf[turn]]
            columns = [pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(numbers, ("<i8", "<i8", "<i4", "<i4", "<i4", "<i4"), strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array([counted], pa.int64()), pa.array([total], pa.int64()), *columns], names=names)
            counted = total = n_docs = 0
            held.clear()
            return out

        for batch in batches:
            own = batch["doc_id"].fill_null(_NO_ID).to_numpy()
            for part in slices(batch["text"]):
                lowered, found = _terms(part)
                counted += int((found.counts > 0).sum())
                total += len(found.starts)
                at, number = known.places(word_hashes(lowered.data, found), lowered, found)
                owner = np.searchsorted(found.first, at, "right") - 1
                key, tf = np.unique(owner * len(known) + number, return_counts=True)
                if len(key):
                    holders, doc = np.unique(key // len(known), return_inverse=True)
                    held.append((own[part.first + holders], found.counts[holders], doc + n_docs, key % len(known), tf))
                    n_docs += len(holders)
                if n_docs >= most_docs or sum(len(x[2]) for x in held) >= most_postings:
                    yield flush()
        if counted:
            yield flush()

    return docs.mapInArrow(run, _SEGMENT)


#: Stands for a null doc_id inside segments: behind every other.
_NO_ID = 2**63 - 1


class Segment:
    """The lists of one segment, with every posting's worth and, by blocks of documents, its largest."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weights: np.ndarray):
        self.ids = np.frombuffer(row["ids"], "<i8")
        sizes = np.frombuffer(row["sizes"], "<i8")
        self.term, length = np.frombuffer(row["term"], "<i4"), np.frombuffer(row["length"], "<i4").astype(np.int64)
        self.doc, tf = np.frombuffer(row["doc"], "<i4").astype(np.int64), np.frombuffer(row["tf"], "<i4").astype(np.int64)
        self.start = np.r_[0, np.cumsum(length)]
        if len(sizes) and 25 * int(sizes.max()) * n_docs >= 2**63:
            m = np.array([75 + 25 * int(s) * n_docs // n_terms for s in sizes], np.int64)
        else:
            m = 75 + 25 * sizes * n_docs // n_terms
        self.worth = np.repeat(weights[self.term], length) * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc]))
        self.short = max(1, len(self.ids) // SHORT)
        self.blocks = -(-len(self.ids) // BLOCK)
        # Largest worth of every list in every block, for the lists that are skipped through.
        self.most = np.zeros((len(self.term), self.blocks), np.int64)
        if len(self.doc):
            cell = np.repeat(np.arange(len(self.term)) * self.blocks, length) + self.doc // BLOCK
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            self.most.ravel()[cell[first]] = np.maximum.reduceat(self.worth, first)

    def lists(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists that the segment has for these terms, and how often each counts."""
        at = np.searchsorted(self.term, terms)
        have = self.term[np.minimum(at, len(self.term) - 1)] == terms if len(self.term) else np.zeros(len(terms), bool)
        return at[have], times[have]

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and doc_ids of the k best documents among those with ``least`` or more.

        Short lists are added up term at a time, to one list of documents with exact partial scores. It and
        the long lists are walked together, document at a time, block by block: a block is left if the
        largest values of the lists in it don't reach the kth score, and inside a block a document goes as
        soon as what it has and the bounds of the lists not yet looked at don't reach it.
        """
        rows, times = self.lists(terms, times)
        size = self.start[rows + 1] - self.start[rows]
        brief = size <= self.short
        summed = np.zeros(len(self.ids), np.int64)
        for r, t in zip(rows[brief].tolist(), times[brief].tolist(), strict=True):
            span = slice(self.start[r], self.start[r + 1])
            summed[self.doc[span]] += t * self.worth[span]  # a document comes once in a list
        edges = np.arange(0, len(self.ids), BLOCK)
        most = np.maximum.reduceat(summed, edges) if len(edges) else np.zeros(0, np.int64)

        rows, times = rows[~brief], times[~brief]
        bounds = self.most[rows] * times[:, None]
        bound = most + bounds.sum(axis=0)
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] < least:
                break
            low, high = block * BLOCK, min((block + 1) * BLOCK, len(self.ids))
            order = np.argsort(-bounds[:, block], kind="stable")
            rest = int(bounds[:, block].sum())
            docs, have = np.arange(low, high), summed[low:high].copy()
            for i in order.tolist():
                keep = have + rest >= least
                docs, have = docs[keep], have[keep]
                if not len(docs) or not bounds[i, block]:
                    break
                span = self.doc[self.start[rows[i]] : self.start[rows[i] + 1]]
                at = np.searchsorted(span, docs)
                hit = span[np.minimum(at, len(span) - 1)] == docs
                have[hit] += times[i] * self.worth[self.start[rows[i]] + at[hit]]
                rest -= int(bounds[i, block])
            good = have >= least
            scores, ids = np.r_[scores, have[good]], np.r_[ids, self.ids[docs[good]]]
            if len(scores) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(scores) == k:
                least = max(least, int(scores.min()))
        best = np.lexsort((ids, -scores))
        return scores[best], ids[best]


def _found(segments: DataFrame, sent: Broadcast, weights: Broadcast, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of every item in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Asked = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(known.items)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("ids", "sizes", "term", "length", "doc", "tf")}
                segment = Segment(row, n_docs, n_terms, weights.value)
                for item, (terms, times) in enumerate(known.wanted):
                    scores, ids = best[item]
                    least = max(1, int(scores.min())) if len(scores) == k else 1
                    more, of = segment.top(terms, times, k, least)
                    scores, ids = np.r_[scores, more], np.r_[ids, of]
                    turn = np.lexsort((ids, -scores))[:k]
                    best[item] = scores[turn], ids[turn]
        if not best:
            return
        sizes = [len(s) for s, _ in best]
        columns = [np.repeat(known.items, sizes), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])]
        part = np.full(len(columns[0]), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, part)], names=["item", "doc_id", "score", "part"])

    return segments.drop("docs", "terms").mapInArrow(run, "item long, doc_id long, score long, part int")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term = np.frombuffer(b"".join(batch["term"].to_pylist()), "<i4")
        length = np.frombuffer(b"".join(batch["length"].to_pylist()), "<i4")
        distinct, turn = np.unique(term, return_inverse=True)
        df = np.bincount(turn, weights=length).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(df)], names=["term", "df"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, most_terms: int = MOST_TERMS, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for every item, best first, smaller doc_ids on ties.

    Terms are runs of letters, digits and non-ASCII characters, lower-cased in A-Z only. A document's score
    sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + (25 n N) div L; only scores above 0 count.

    Null texts have no terms. Null doc_ids come last on ties and stay null; rows with one doc_id are documents
    of their own, and each row of ``items`` is an item of its own. Items without results have no rows. Extra
    columns are ignored; without documents or items there are no rows. Texts are read whole.

    Documents are never shuffled: each task builds segments of inverted lists for the terms that are asked
    for, which are written once; N, L and df are sums over the segments. Items are asked in blocks with at
    most about ``most_terms`` terms, or one item, which bounds what is broadcast. A task keeps k documents an
    item; these meet in two steps. Terms are compared by 128 bits of hash.
    """
    numbered = pick(items, item_id="long", text="string").withColumn("item", F.monotonically_increasing_id())
    numbered = written(numbered.withColumn("n", F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))), "items")
    blocks = max(1, -(-(numbered.agg(F.sum("n")).first()[0] or 0) // most_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    texts = pick(docs, doc_id="long", text="string")
    out = [_ranked(texts, numbered.filter(block == b), k, segment_docs, segment_postings) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    order = [F.desc("score"), F.col("doc_id")]
    some = found.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("place") <= k)
    ranks = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    known = numbered.select("item", "item_id")
    return ranks.join(known, "item").select("item_id", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _ranked(texts: DataFrame, items: DataFrame, k: int, segment_docs: int, segment_postings: int) -> DataFrame:
    spark = texts.sparkSession
    context = spark.sparkContext
    known = asked([(r["item"], r["text"]) for r in items.select("item", "text").collect()])
    sent = context.broadcast(known)
    segments = written(_segments(texts, sent, segment_docs, segment_postings), "segments")
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    counted = segments.select("term", "length").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(max(1, len(known)), np.int64)
    for r in counted.collect():  # a row per term asked for
        weights[r["term"]] = weight(n_docs, r["df"])
    return _found(segments, sent, context.broadcast(weights), n_docs, n_terms, k)
