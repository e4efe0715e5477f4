"""Document quality by an additive model with pairwise interactions, scored from lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablewright.llm.learning import MOST_LABELLED, held_out, labelled_sample
from tablewright.llm.shared import pick
from tablewright.llm.texts import Slice, mixed, slices, windows, word_hashes, words

FEATURES = (
    "words",
    "word_length",
    "letters",
    "digits",
    "capitals",
    "stops",
    "shouts",
    "symbols",
    "odd_endings",
    "bars",
    "lines",
    "distinct_words",
    "repeated_neighbours",
    "commonest_word",
    "distinct_pairs",
)
#: Byte classes: 0 other, 1 lower-case letter or part of a non-ASCII character, 2 digit, 3 capital, 4 . , ; : ?,
#: 5 !, 6 other ASCII symbol, 7 |, 8 line end.
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 6
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 7
_CLASS[10] = 8


def quality_features(part: Slice) -> np.ndarray:
    """(texts, features): shares and counts of a whole text; zeros for a wordless one."""
    n = len(part)
    found = words(part)
    counts, nonzero = found.counts, np.maximum(found.counts, 1)
    text = np.repeat(np.arange(n), counts)
    by_class = np.bincount(np.repeat(np.arange(n) * 9, np.diff(part.offsets)) + _CLASS[part.data], minlength=9 * n).reshape(n, 9)
    visible = np.maximum(by_class[:, 1:8].sum(axis=1), 1)
    hashes = word_hashes(part.data, found)
    last = _CLASS[part.data[found.ends - 1]] if len(text) else np.zeros(0, np.int64)
    odd = np.bincount(text, (last >= 5) & (last <= 7), n)

    def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values per text, and how often its commonest occurs."""
        _, at, times = np.unique(values + mixed(owner.astype(np.uint64), 5), return_index=True, return_counts=True)
        most = np.zeros(n)
        np.maximum.at(most, owner[at], times)
        return np.bincount(owner[at], minlength=n), most

    alike, common = distinct(hashes, text)
    at, owner = windows(found, 2)
    pairs = mixed(hashes[at], 9) + hashes[at + 1] if len(at) else np.zeros(0, np.uint64)
    different, _ = distinct(pairs, owner)
    same = np.bincount(owner, hashes[at] == hashes[at + 1], n) if len(at) else np.zeros(n)
    out = [
        np.log1p(counts),
        by_class[:, 1:8].sum(axis=1) / nonzero,
        (by_class[:, 1] + by_class[:, 3]) / visible,
        by_class[:, 2] / visible,
        by_class[:, 3] / visible,
        by_class[:, 4] / nonzero,
        by_class[:, 5] / nonzero,
        by_class[:, 6] / visible,
        odd / nonzero,
        by_class[:, 7] / nonzero,
        by_class[:, 8] / nonzero,
        alike / nonzero,
        same / nonzero,
        common / nonzero,
        different / np.maximum(counts - 1, 1),
    ]
    return np.stack(out, axis=1) * (counts > 0)[:, None]


@dataclass
class AdditiveModel:
    """Log-odds as a sum: one table per feature, and one per pair of features on coarser bins."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.coarse_cuts)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values over the bins of one feature: the best splits of a tree of this depth."""
    whole = g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge)
    k = int(np.argmax(gain)) + 1
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One cut of the first feature, then one of the second on either side; and the gain of the four cells."""
    best, table = -1.0, np.zeros(g.shape)
    for k in range(1, g.shape[0]):
        out, gain = np.empty(g.shape), 0.0
        for rows in (slice(0, k), slice(k, None)):
            values = _tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 1, ridge)
            out[rows] = values
            gain += float((values * g[rows].sum(axis=0)).sum())
        if gain > best:
            best, table = gain, out
    return table, best


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.2, bins: int = 32, coarse: int = 8, n_pairs: int = 6, ridge: float = 1.0
) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature a shallow tree on what is left to explain, then the
    strongest pairs do the same on the residual. A single class, or no rows, gives a constant."""
    if len(y) == 0 or y.min() == y.max():
        rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
        return AdditiveModel(base=float(np.log(rate_of_ones / (1 - rate_of_ones))))
    model = AdditiveModel(base=float(np.log(y.mean() / (1 - y.mean()))))
    model.cuts = [_quantiles(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.coarse_cuts = [_quantiles(x[:, f], coarse) for f in range(x.shape[1])]
    fine = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    broad = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.coarse_cuts)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, (where, table) in enumerate(zip(fine, model.tables, strict=True)):
            g, h = slopes()
            step = rate * _tree(np.bincount(where, g, len(table)), np.bincount(where, h, len(table)), 2, ridge)
            model.tables[f] = table + step
            total += step[where]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse_cuts[a]) + 1, len(model.coarse_cuts[b]) + 1)
        cell = broad[a] * shape[1] + broad[b]
        g, h = slopes()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            _, g, h = grid(a, b)
            gains.append((_pair_tree(g, h, ridge)[1], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.coarse_cuts[a]) + 1, len(model.coarse_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for i, (a, b) in enumerate(model.pairs):
            cell, g, h = grid(a, b)
            step = rate * _pair_tree(g, h, ridge)[0]
            model.pair_tables[i] = model.pair_tables[i] + step
            total += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AdditiveModel:
    """The model of ``labels.quality`` from at most ``most`` labelled texts outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"]):
                rows = slice(part.first, part.first + len(part))
                values = pa.array(list(quality_features(part)), pa.list_(pa.float64()))
                own = [batch[c].slice(rows.start, len(part)) for c in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, values], names=["doc_id", "label", "x"])

    found = labelled_sample(docs, labels, "quality", most).select("doc_id", "label", "text")
    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in found.mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    x = np.array([r[2] for r in rows]).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array([float(r[1] > 0) for r in rows]))


def _with_score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """row (all columns of ``docs`` in a struct) and score."""
    column = [c.lower() for c in docs.columns].index("text")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(quality_features(part)) for part in slices(batch["row"].field(column).cast(pa.string()))]
            if found:
                yield batch.append_column("score", pa.array(np.concatenate(found)))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold``) of every document.

    Scores come from the text alone. Null and empty texts have all features zero and the score of that; a
    null doc_id is held out. Repeated rows score alike; extra columns are ignored; no rows, no rows. Without
    labels, or with one class of them, every document has the same score.
    """
    out = _with_score(pick(docs, doc_id="long", text="string"), train(docs, labels, most))
    predicted = (F.col("score") >= threshold).cast("int")
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    return _with_score(docs, train(docs, labels, most)).filter(F.col("score") >= threshold).select("row.*")
