"""Near duplicates by SimHash, linked through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewright.llm.components import components
from tablewright.llm.shared import LAST_ID, pick, written
from tablewright.llm.texts import LOWER, Slice, bit_counts, slices, within, words

_U64 = np.uint64
#: Members of a node per level of the index.
FANOUT = 8
#: Queries that descend the index together.
TOGETHER = 4096
#: Nodes that are opened together, a bound of memory: each has up to FANOUT nodes below.
WALKED = 16_384


def simhashes(part: Slice, width: int = 3, seed: int = 42) -> np.ndarray:
    """A fingerprint per text of a slice: the bits set in over half the XXH64 of its word shingles."""
    lowered = Slice(part.first, LOWER[part.data], part.offsets)
    found = words(lowered)
    sizes = found.ends - found.starts
    n = len(sizes)
    joined = np.full(int(sizes.sum()) + n, 32, np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    joined[np.repeat(starts, sizes) + within(sizes)] = lowered.data[np.repeat(found.starts, sizes) + within(sizes)]
    ends = starts + sizes

    counts = found.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(found.first[:-1], shingles) + within(shingles)
    last = np.repeat(np.minimum(width, counts) - 1, shingles) + first
    raw, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([hashed(raw[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], _U64)
    bits = 2 * bit_counts(hashes, shingles) > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row; null and wordless texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhashes(part, width, seed) for part in slices(batch["text"])]
            if found:
                fp = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], fp], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a number in the binary reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U64(shift)
    return x


class GrayIndex:
    """Fingerprints of several groups, each in Gray order under its own tree.

    Neighbours in Gray order share long bit patterns. A node keeps the mask of the bits on which all its
    fingerprints agree and their values there; bits that its parent has settled are not compared again, so
    the differences found on the way down add up to the distance, and a node that exceeds the limit takes
    its whole group with it. ``fps`` must lie group by group, in Gray order; ``groups`` are the first places.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.fps = fps
        first, size = groups, np.diff(np.r_[groups, len(fps)])
        ones = zeros = fps
        below = np.arange(len(fps) + 1)
        self.levels = []
        while True:
            blocks = -(-size // FANOUT)
            start = np.repeat(first, blocks) + FANOUT * within(blocks)
            ones, zeros = np.bitwise_and.reduceat(ones, start), np.bitwise_or.reduceat(zeros, start)
            leaf_end = below[np.r_[start[1:], len(below) - 1]]
            self.levels.append((start, np.r_[start[1:], len(below) - 1], leaf_end, ones, ~(ones ^ zeros)))
            below = np.r_[below[start], len(fps)]
            first, size = np.cumsum(blocks) - blocks, blocks
            if (blocks == 1).all():
                break
        self.root = np.repeat(np.arange(len(groups)), np.diff(np.r_[groups, len(fps)]))

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places at distance ``most`` or less whose closure links all such pairs.

        At most ``WALKED`` nodes are opened at a time, the deepest first, so memory doesn't grow with the
        number of pairs. Nodes whose places are all known to be linked to a query aren't entered: what is
        known is brought up to date whenever about as much was walked as that takes. ``label`` ends as the
        smallest place that each place is linked to.
        """
        n = len(self.fps)
        self.label = np.arange(n)
        self._note_known()
        walked = 0
        for low in range(0, n, TOGETHER):
            query = np.arange(low, min(low + TOGETHER, n))
            depth, node = len(self.levels) - 1, self.root[query]
            seen, spent = np.zeros(len(query), _U64), np.zeros(len(query), np.int64)
            waiting: list[tuple] = []
            while True:
                walked += len(query)
                query, node, spent, a, b = self._near(depth, query, node, seen, spent, most)
                if len(a):
                    _join(self.label, a, b)
                    yield a, b
                if walked > 4 * n:
                    self._note_known()
                    walked = 0
                if len(query):
                    waiting.append((depth, query, node, spent))
                if not waiting:
                    break
                depth, query, node, spent = waiting.pop()
                if len(query) > WALKED:
                    waiting.append((depth, query[WALKED:], node[WALKED:], spent[WALKED:]))
                    query, node, spent = query[:WALKED], node[:WALKED], spent[:WALKED]
                fresh = self.known[depth][node] != self.known[-1][query]
                query, node, spent = query[fresh], node[fresh], spent[fresh]
                start, end, _, _, mask = self.levels[depth]
                fan = end[node] - start[node]
                seen = np.repeat(mask[node], fan)
                query, spent, node = np.repeat(query, fan), np.repeat(spent, fan), np.repeat(start[node], fan) + within(fan)
                depth -= 1
        _settle(self.label)

    def _near(self, depth: int, query: np.ndarray, node: np.ndarray, seen: np.ndarray, spent: np.ndarray, most: int) -> tuple:
        """Nodes to enter (query, node, spent) and the links found on the way."""
        if depth < 0:
            spent = spent + np.bitwise_count((self.fps[query] ^ self.fps[node]) & ~seen)
            near = (spent <= most) & (node > query)
            return query[:0], node[:0], spent[:0], query[near], node[near]
        _, _, leaf_end, value, mask = self.levels[depth]
        spent = spent + np.bitwise_count((self.fps[query] ^ value[node]) & mask[node] & ~seen)
        near = (spent <= most) & (leaf_end[node] > query + 1) & (self.known[depth][node] != self.known[-1][query])
        query, node, spent = query[near], node[near], spent[near]
        whole = spent + np.bitwise_count(~mask[node]) <= most  # every fingerprint below is a match
        enter = ~whole
        return query[enter], node[enter], spent[enter], query[whole], leaf_end[node[whole]] - 1

    def _note_known(self) -> None:
        """For each level the label that all places of a node have, else -1; last, the labels themselves."""
        _settle(self.label)
        low = high = self.label.copy()
        places, self.known = low, []
        for start, *_ in self.levels:
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            self.known.append(np.where(low == high, low, -1))
        self.known.append(places)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang the trees of linked places together, larger roots below smaller ones, in place."""
    while len(a):
        both = np.concatenate([a, b])
        while True:
            up = label[label[both]]
            if (up == label[both]).all():
                break
            label[both] = up
        a, b = up[: len(a)], up[len(a) :]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _settle(label: np.ndarray) -> None:
    """Give every place the root of its tree."""
    while True:
        up = label[label]
        if (up == label).all():
            break
        label[:] = up


def block_masks(differences: int = 3, blocks: int = 5) -> list[int]:
    """Masks of which two numbers with at most so many differing bits agree on at least one: the bits in
    ``blocks`` parts, of which at least blocks - differences are untouched."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(parts, blocks - differences)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_links(prints: DataFrame, differences: int = 3, blocks: int = 5) -> DataFrame:
    """Edges a, b between distinct fingerprints whose closure links all at ``differences`` or fewer bits.

    Two such fingerprints agree on two of five blocks of bits. So each is dealt to ten groups, one for every
    choice of two blocks and their value, and each group searches itself through a ``GrayIndex``. A group
    gives a forest: fewer edges than members, whatever the number of pairs in it. Groups are about 2**-25
    of all fingerprints; many of them share a task, one after the other.
    """
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(differences, blocks)])
    dealt = prints.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    # Shifting by a power of two and folding gives the inverse of the Gray code, the rank to sort by.
    rank: Column = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    dealt = dealt.withColumn("rank", rank).repartition("mask", "key").sortWithinPartitions("mask", "key", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")])
            if not rows.shape[1]:
                continue
            # The last group may go on in the next batch.
            fresh = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            if held and (rows[:2, 0] != held[-1][:2, -1]).any():
                yield from _forest(np.concatenate(held, axis=1), differences)
                held = []
            cut = int(fresh[-1]) if len(fresh) else 0
            if cut:
                yield from _forest(np.concatenate([*held, rows[:, :cut]], axis=1), differences)
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from _forest(np.concatenate(held, axis=1), differences)

    return dealt.select("mask", "key", "fp").mapInArrow(run, "a long, b long").distinct()


def _forest(rows: np.ndarray, differences: int) -> Iterator[pa.RecordBatch]:
    change = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0), True]
    shared = ~(change[:-1] & change[1:])  # alone in its group: nothing to link
    fps = rows[2, shared].view(np.uint64)
    if not len(fps):
        return
    index = GrayIndex(fps, np.flatnonzero(change[:-1][shared]))
    for _ in index.links(differences):
        pass
    label = index.label
    linked = np.flatnonzero(label != np.arange(len(fps)))
    if len(linked):
        ends = [pa.array(fps[x].view(np.int64)) for x in (linked, label[linked])]
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def near_groups(docs: DataFrame, differences: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links, itself included) per row.

    Texts are lower-cased in A-Z only; shingles are runs of ``width`` words joined by one space, repeats
    included; shorter texts are one shingle, wordless and null ones have fingerprint 0, which links like any
    other. Equal fingerprints are one node, so copies are never paired. Null doc_ids count as the largest
    number; a group of null doc_ids alone has component_id null. Rows with one doc_id are linked through
    their own fingerprints. Extra columns are ignored; an empty table has no rows.
    """
    return _grouped(docs, differences, width, seed).drop("root")


def _grouped(docs: DataFrame, differences: int, width: int, seed: int) -> DataFrame:
    """``near_groups`` and root, a fingerprint that tells the group from every other, whatever its doc_ids."""
    prints = written(fingerprints(docs, width, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("low")), "nodes")
    member = components(fingerprint_links(nodes.select("fp"), differences))
    rooted = member.join(nodes, member["node"] == nodes["fp"]).select("node", "root", "low")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    linked = rooted.join(lowest, "root").select(F.col("node").alias("fp"), "root", "lowest")
    labels = nodes.join(linked, "fp", "left")
    labels = labels.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", "low").alias("lowest"))
    out = prints.join(labels, "fp")
    return out.select("doc_id", "fp", F.when(F.col("lowest") != LAST_ID, F.col("lowest")).alias("component_id"), "root")


def distinct_documents(docs: DataFrame, differences: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of every near-duplicate group, with all its columns: that of the smallest (doc_id, fingerprint).

    Groups are told apart by their links, not by doc_ids, which may be null or repeat with other texts.
    """
    groups = _grouped(docs, differences, width, seed)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "fp")).alias("kept"))
    kept = kept.select("kept.id", "kept.fp")
    have = {c.lower(): c for c in docs.columns}
    column = docs.columns.index(have["text"])
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.coalesce(docs[f"`{have['doc_id']}`"].cast("long"), F.lit(LAST_ID)).alias("id"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhashes(part, width, seed) for part in slices(batch["row"].field(column).cast(pa.string()))]
            if found:
                yield batch.append_column("fp", pa.array(np.concatenate(found).view(np.int64)))

    marked = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))
    return marked.join(kept, ["id", "fp"], "left_semi").dropDuplicates(["id", "fp"]).select("row.*")
