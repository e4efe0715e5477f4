"""Toxicity by a classifier chain: linear models over word evidence, each fed the ones before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.learning import MOST_LABELLED, held_out, labelled_sample
from tablewright.llm.shared import pick
from tablewright.llm.texts import _BYTES, LOWER, Slice, slices, span_hashes, words

#: The chain, in its order. A toxic document is also abusive if it holds evidence words, and severe if it
#: holds more of them for its length than half of the toxic ones.
CATEGORIES = ("abusive", "severe", "toxic")
#: Words and word beginnings that serve as evidence.
MOST_EVIDENCE = 256
#: Buckets that words are hashed to.
BUCKET_BITS = 22
#: Beginnings of a word, in bytes, that count besides the word itself.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 4
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def evidence_buckets(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every word and beginning of a word, and the word counts of the texts. Words are
    lower-cased in A-Z and stripped of ASCII punctuation at either end."""
    data = LOWER[part.data]
    found = words(Slice(0, data, part.offsets))
    place, bare = np.arange(len(data)), ~_PUNCTUATION[data]
    after = np.minimum.accumulate(np.where(bare, place, len(data))[::-1])[::-1]  # the next byte to keep
    before = np.maximum.accumulate(np.where(bare, place, -1))
    starts = np.minimum(after[found.starts], found.ends)
    ends = np.maximum(before[found.ends - 1] + 1, starts)
    text = np.repeat(np.arange(len(part)), found.counts)
    long = [starts + n < ends for n in BEGINNINGS]
    first = np.concatenate([starts, *[starts[x] for x in long]])
    last = np.concatenate([ends, *[starts[x] + n for x, n in zip(long, BEGINNINGS, strict=True)]])
    owner = np.concatenate([text, *[text[x] for x in long]])
    begun = np.concatenate([np.zeros(len(starts), bool), *[np.ones(x.sum(), bool) for x in long]])
    seen = first < last
    hashes = span_hashes(_BYTES[0][data], first[seen], last[seen]) ^ begun[seen].astype(np.uint64)
    bucket = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return owner[seen], bucket, found.counts


def evidence_features(part: Slice, chosen: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(texts, len(chosen) + 3): log counts of the chosen buckets, of all their hits, hits to a hundred words, words."""
    owner, bucket, counts = evidence_buckets(part)
    at = place[bucket]
    hit = at >= 0
    n, k = len(part), len(chosen)
    hits = np.bincount(owner[hit] * k + at[hit], minlength=n * k).reshape(n, k) if k else np.zeros((n, 0))
    total = hits.sum(axis=1)
    rest = [np.log1p(total), np.log1p(100 * total / np.maximum(counts, 1)), np.log1p(counts)]
    return np.concatenate([np.log1p(hits), np.stack(rest, axis=1)], axis=1)


def places(chosen: np.ndarray) -> np.ndarray:
    place = np.full(1 << BUCKET_BITS, -1, np.int16)
    place[chosen] = np.arange(len(chosen))
    return place


def choose_evidence(sample: DataFrame, most: int = MOST_EVIDENCE) -> np.ndarray:
    """Buckets that speak most for label 1: found in at least three positive texts, ranked by their share of
    the positive texts times the log of how much more often they are found in those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch["label"].to_numpy()
            for part in slices(batch["text"]):
                owner, bucket, _ = evidence_buckets(part)
                once = np.unique(owner << BUCKET_BITS | bucket)
                toxic = label[part.first + (once >> BUCKET_BITS)] > 0
                own, which = np.unique(once & ((1 << BUCKET_BITS) - 1), return_inverse=True)
                yes = np.bincount(which, toxic, len(own)).astype(np.int64)
                no = np.bincount(which, ~toxic, len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(yes), pa.array(no)], names=["bucket", "yes", "no"])

    n_yes, n_no = sample.agg(F.sum(F.col("label").cast("long")), F.sum(1 - F.col("label").cast("long"))).first()
    if not n_yes or not n_no:
        return np.zeros(0, np.int64)
    found = sample.select("label", "text").mapInArrow(run, "bucket long, yes long, no long")
    found = found.groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter("yes >= 3")
    more = F.ln(((F.col("yes") + 0.5) / n_yes) / ((F.col("no") + 0.5) / n_no))
    best = found.orderBy(F.desc(F.col("yes") / n_yes * more), "bucket").limit(most)
    return np.array(sorted(r["bucket"] for r in best.select("bucket").collect()), np.int64)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant. One class gives a constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weights = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return weights
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def linear(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


@dataclass
class Chain:
    """Evidence buckets and a linear model per category."""

    chosen: np.ndarray
    models: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        known = np.zeros((len(x), 0))
        for weights in self.models:
            p = linear(np.concatenate([x, known], axis=1), weights)
            known = np.concatenate([known, p[:, None]], axis=1)
        return known


def fit_chain(x: np.ndarray, y: np.ndarray, chosen: np.ndarray, folds: int = FOLDS) -> Chain:
    """Models of the columns of ``y`` in order. Each learns from the features and the probabilities of the
    categories before it; on the training rows those come from models that haven't seen the row."""
    chain, known = Chain(chosen), np.zeros((len(x), 0))
    fold = np.arange(len(x)) % folds
    for c in range(y.shape[1]):
        inputs = np.concatenate([x, known], axis=1)
        chain.models.append(fit_linear(inputs, y[:, c]))
        unseen = np.zeros(len(x))
        for f in range(folds):
            if (fold == f).any():
                unseen[fold == f] = linear(inputs[fold == f], fit_linear(inputs[fold != f], y[fold != f, c]))
        known = np.concatenate([known, unseen[:, None]], axis=1)
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_evidence: int = MOST_EVIDENCE) -> Chain:
    """The chain of ``CATEGORIES`` from ``labels.toxic`` of at most ``most`` texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", most).withColumn("label", (F.col("label") > 0).cast("int"))
    chosen = choose_evidence(sample, most_evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(chosen)
        for batch in batches:
            for part in slices(batch["text"]):
                rows = evidence_features(part, chosen, place).astype(np.float32)
                own = [batch[c].slice(part.first, len(part)) for c in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "x"])

    found = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x binary").collect()
    rows = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in found)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), len(chosen) + 3).astype(np.float64)
    toxic = np.array([float(r[1]) for r in rows])
    hits, density = x[:, len(chosen)], x[:, len(chosen) + 1]
    common = np.median(density[toxic > 0]) if toxic.any() else 0.0
    y = np.stack([toxic * (hits > 0), toxic * (density > common), toxic], axis=1)
    return fit_chain(x, y, chosen)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, a probability for each category, score (that of toxic), predicted (1 from ``threshold``).

    Scores come from the whole text alone. Null and empty texts have no evidence and the score of that;
    repeated rows score alike; null doc_ids are scored and count as held out; extra columns are ignored; no
    rows, no rows. Without labels, or with one class of them, every document of one length scores alike.
    """
    chain = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(chain.chosen)
        for batch in batches:
            for part in slices(batch["text"]):
                p = chain.probabilities(evidence_features(part, chain.chosen, place))
                own = batch["doc_id"].slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(p[:, i]) for i in range(len(CATEGORIES))]], names=["doc_id", *CATEGORIES])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES)
    out = pick(docs, doc_id="long", text="string").mapInArrow(run, schema)
    last = F.col(CATEGORIES[-1])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), *CATEGORIES, last.alias("score"), (last >= threshold).cast("int").alias("predicted")
    )
