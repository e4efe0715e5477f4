"""Homomorphic document fingerprints: wide vectors hashed from paragraphs, added modulo powers of two."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import LAST_ID, pick
from tablewright.llm.texts import _BYTES, Slice, bit_counts, mixed, slices, span_hashes, within, word_hashes, words

#: Words that tell whether two paragraphs are equal, each modulo 2**64.
EXACT = 8
#: Words of a paragraph's shingles.
SHINGLE = 5
#: Signed counters that tell how much two texts share, each modulo 2**16.
LANES = 128
#: Bytes of a fingerprint: the exact words, then the counters, little-endian.
BYTES = 8 * EXACT + 2 * LANES
#: Documents of a range, about. Small ranges spread evenly over tasks; there are at most MOST_PARTS of them.
PER_TASK = 5_000
MOST_PARTS = 100_000
#: Bits of hash by which rows of one frequent id stand; with an id's rank they fit the 53 bits of a double.
TIE_BITS = 36


def fingerprint_arrays(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(texts, EXACT) unsigned words and (texts, LANES) signed counters of a slice.

    A paragraph is a run of bytes without line ends. It gives one random vector of exact words, from 128 bits
    of hash of its bytes, and one vector of counters: +1 or -1 for each of its five-word shingles (all its
    words, if fewer) in every lane. A document is the sum over its paragraphs.
    """
    n, data = len(part), part.data
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 10
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[part.offsets[:-1]] = inside[part.offsets[:-1]]
    opens[-1] = False
    starts = np.flatnonzero(opens)
    stops = np.sort(np.concatenate([np.flatnonzero(~inside), part.offsets]))
    ends = stops[np.searchsorted(stops, starts, "right")]
    owner = np.searchsorted(part.offsets, starts, "right") - 1

    one, two = (span_hashes(_BYTES[s][data], starts, ends, s) for s in (0, 1))
    exact = np.zeros((n, EXACT), np.uint64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    for k in range(EXACT):
        vector = mixed(one, 30 + k) ^ mixed(two, 40 + k)
        if len(first):
            exact[owner[first], k] = np.add.reduceat(vector, first)

    paragraphs = Slice(0, data, np.r_[starts, len(data)]) if len(starts) else Slice(0, data, np.zeros(1, np.int64))
    found = words(paragraphs)
    hashes = word_hashes(data, found)
    counts = found.counts
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    at = np.repeat(found.first[:-1], shingles) + within(shingles)
    grams = span_hashes(hashes, at, at + np.repeat(np.minimum(counts, SHINGLE), shingles))
    per_text = np.bincount(owner, shingles, n).astype(np.int64)
    lanes = [2 * bit_counts(mixed(grams, 50 + k), per_text) - per_text[:, None] for k in range(LANES // 64)]
    return exact, np.concatenate(lanes, axis=1).astype(np.int16)


def packed(exact: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    raw = np.concatenate([exact.astype("<u8").view(np.uint8), np.ascontiguousarray(lanes.astype("<i2")).view(np.uint8)], axis=1)
    return [row.tobytes() for row in raw]


def _parts(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint, "<u8", EXACT), np.frombuffer(fingerprint, "<i2", LANES, 8 * EXACT)


def fingerprint(text: str | None) -> bytes:
    (part,) = slices(pa.array([text], pa.string()))
    return packed(*fingerprint_arrays(part))[0]


def inserted(old: bytes, paragraphs: str) -> bytes:
    """The fingerprint after paragraphs are added anywhere in the text."""
    a, b = _parts(old), _parts(fingerprint(paragraphs))
    return packed((a[0] + b[0])[None], (a[1] + b[1])[None])[0]


def deleted(old: bytes, paragraphs: str) -> bytes:
    """The fingerprint after paragraphs are taken out."""
    a, b = _parts(old), _parts(fingerprint(paragraphs))
    return packed((a[0] - b[0])[None], (a[1] - b[1])[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1, per row. The difference of two fingerprints is that of what only one text has; the mean square
    of its counters estimates how much that is, against what both have. 1 exactly when all exact words agree."""
    x, y = a[1].astype(np.int16), b[1].astype(np.int16)
    apart = ((x - y).astype(np.float64) ** 2).mean(axis=1)
    both = (x.astype(np.float64) ** 2).mean(axis=1) + (y.astype(np.float64) ** 2).mean(axis=1)
    share = np.clip(1 - apart / np.where(both > 0, both, 1), 0, 1) * (both > 0)
    return np.where((a[0] == b[0]).all(axis=1), 1.0, share)


def _edited(text: str, after: str) -> str:
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


def edit_likeness(docs: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    The edited text has its last quarter of code points replaced by as many from the start of the next
    document by ascending doc_id; the last document's next is the first. Null texts are empty. Null doc_ids
    come last; rows with one doc_id stand by text, and equal rows are interchangeable. A single document is
    its own next. Extra columns are ignored; no rows, no rows.

    Documents are dealt to ranges of doc_id that begin at ids taken from the data, and each range also gets
    the first document of the next one. So the texts are shuffled once, and neighbours meet in one task. An id
    of more rows than a range should have is split: its rows stand by the upper bits of a hash of the text,
    then by text, and further ranges begin at such hashes. Equal rows that fill several ranges take turns in them.
    """
    rows = pick(docs, doc_id="long", text="string").select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ids = rows.select("id")
    n, lowest = ids.agg(F.count("*"), F.min("id")).first()
    spark = docs.sparkSession
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 64 - TIE_BITS))
    most = max(per_task, -(-n // MOST_PARTS))
    hot = _hot_cuts(rows, most) if n else {}
    single = set(_bounds(ids, max(1, -(-n // most)))) if n else set()
    first = (lowest, min(hot[lowest])) if lowest in hot else (lowest, 0)
    cuts = sorted([(i, 0) for i in single - set(hot)] + [(i, tie) for i, ties in hot.items() for tie in ties])
    if first in cuts:
        cuts.remove(first)
    parts, split = len(cuts) + 1, np.array(sorted(hot), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # How often a place came up does not depend on the order of rows, so a task that runs again deals alike.
        turns: dict[tuple[int, int], int] = {}
        least: dict[int, tuple[int, str]] = {}  # per range, the first document of the next that was sent
        shift = TaskContext.get().partitionId() * 7919
        for batch in batches:
            own = batch["id"].to_numpy()
            ties = np.where(np.isin(own, split), batch["tie"].to_numpy(), 0)
            to, taken, target = [], [], []
            for at, place in enumerate(zip(own.tolist(), ties.tolist(), strict=True)):
                low, high = bisect_left(cuts, place), bisect_right(cuts, place)
                turn = 0
                if high - low > 1:
                    seen = turns[place] = turns.get(place, -1) + 1
                    turn = (seen + shift) % (high - low) if seen else 0
                to.append(high - turn)
                before = ([low] if low < high else []) + ([parts - 1] if place == first else [])
                for part in before:
                    key = (place[1], batch["text"][at].as_py())
                    if part not in least or key < least[part]:
                        least[part] = key
                        taken.append(at)
                        target.append(part)
            row = np.concatenate([np.arange(len(own)), np.array(taken, np.int64)])
            extra = np.arange(len(row)) >= len(own)
            columns = [pa.array(own[row]), pa.array(ties[row]), batch["text"].take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to + target, pa.int32()), pa.array(extra), *columns], names=["part", "extra", "id", "tie", "text"]
            )

    dealt = rows.mapInArrow(deal, "part int, extra boolean, id long, tie long, text string")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", "id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, whose next is not seen yet
        done = None  # the part whose last document has its next
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                block = batch.slice(low, 500)
                columns = [block[c].to_pylist() for c in ("part", "extra", "id", "text")]
                own, after = [], []
                for row in zip(*columns, strict=True):
                    if held is not None and not held[1]:
                        own.append(held)
                        # A range that ends without a next document lies within equal rows.
                        after.append(row[3] if held[0] == row[0] else held[3])
                    if row[1] and done == row[0]:
                        continue  # of several first documents of the next part, only the smallest is next
                    done = row[0] if row[1] else done
                    held = row
                if own:
                    yield _compared(own, after)
        if held is not None and not held[1]:
            yield _compared([held], [held[3]])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInArrow(run, schema) if n else spark.createDataFrame([], schema)
    return out.select(F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), *out.columns[1:])


def _hot_cuts(rows: DataFrame, most: int) -> dict[int, list[int]]:
    """Ids of more than ``most`` rows, with the ties at which their ranges begin; as often as equal rows fill one.

    The driver gets at most one id, and one tie, for every ``most`` rows.
    """
    counted = rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).orderBy("id").collect()
    if not counted:
        return {}
    hot = [r["id"] for r in counted]
    spark = rows.sparkSession
    ranks = spark.createDataFrame(list(enumerate(hot)), "rank long, id long")
    places = rows.select("id", "tie").join(ranks, "id").select("rank", (F.col("rank") * (1 << TIE_BITS) + F.col("tie")).alias("place"))
    begins = places.groupBy("rank").agg(F.min("place").alias("place")).collect()
    total = sum(r["n"] for r in counted)
    steps = [k * most / total for k in range(1, -(-total // most))]
    found = places.agg(F.percentile_approx("place", F.array(*map(F.lit, steps)), F.lit(max(10_000, 20 * len(steps))))).first()[0]
    cuts: dict[int, list[int]] = {i: [] for i in hot}
    for place in [r["place"] for r in begins] + list(found):
        cuts[hot[place >> TIE_BITS]].append(place & ((1 << TIE_BITS) - 1))
    return cuts


def _bounds(ids: DataFrame, parts: int) -> list[int]:
    """Ids that divide the table into about equal parts."""
    if parts == 1:
        return []
    step = [(i + 1) / parts for i in range(parts - 1)]
    array = F.array(*[F.lit(s) for s in step])
    return list(ids.agg(F.percentile_approx("id", array, F.lit(max(10_000, 20 * parts)))).first()[0])


def _arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [fingerprint_arrays(part) for part in slices(pa.array(texts, pa.string()))]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compared(own: list[tuple], after: list[str]) -> pa.RecordBatch:
    texts = [row[3] for row in own]
    changed = [_edited(a, b) for a, b in zip(texts, after, strict=True)]
    mine, edited = _arrays(texts), _arrays(changed)
    # The next text is the next row's own, but for the last one.
    last = _arrays(after[-1:])
    follows = tuple(np.concatenate([m[1:], x]) for m, x in zip(mine, last, strict=True))
    odd = [i for i in range(len(own) - 1) if after[i] is not texts[i + 1]]
    if odd:
        other = _arrays([after[i] for i in odd])
        for f, x in zip(follows, other, strict=True):
            f[odd] = x
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[2] for row in own], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([b.hex() for b in packed(*mine)]),
            pa.array([b.hex() for b in packed(*edited)]),
            pa.array(likeness(mine, edited)),
            pa.array(likeness(mine, follows)),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
