"""Near-duplicate vectors: p-stable hashing to buckets in several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.shared import pick, written
from tablewright.llm.texts import mixed, within

_U64 = np.uint64
#: Tables, quantised projections of a table, and the width of a cell. Vectors at a cosine of 0.93 (distance
#: 0.374) share a cell of one projection with probability 0.801, so 0.801**10 = 0.109 of the tables; they
#: meet in one of 32 with 0.975. At 0.95 it is 0.996, from 0.98 on more than 0.99999.
TABLES = 32
PROJECTIONS = 10
WIDTH = 1.5
#: Vectors of a bucket that are compared in one task; larger buckets are dealt in chunks of this size.
TOGETHER = 4096
#: Rows of a block of cosines; groups whose pairs are listed at once, and the components gathered for them.
_ROWS = 256
_SMALL = 32
_CELLS = 1 << 22
#: What tells groups apart in a task, besides the length of the vectors.
_GROUP = ("bucket", "one", "two", "label", "place")


@lru_cache(maxsize=8)
def _planes(size: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([size, tables, projections, 11])
    planes = np.round(rng.standard_normal((size, tables * projections)) * 2**14)
    return planes, np.floor(rng.random(tables * projections) * width * 2**34)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """Of every unit vector its bucket in each table: (vectors, tables), 64 bits that name the cells.

    h = floor((a·x + b) / w) with normal a. Components and projections are rounded to whole multiples of
    2**-20 and 2**-14, so every sum is exact: the keys are the same wherever they are computed.
    """
    planes, shift = _planes(unit.shape[1], tables, projections, width)
    cells = np.floor((np.round(unit * 2**20) @ planes + shift) / (width * 2**34)).astype(np.int64).view(_U64)
    keys = np.broadcast_to(mixed(np.arange(tables, dtype=_U64), 5), (len(unit), tables))
    for p in range(projections):
        keys = mixed(keys ^ mixed(cells[:, p::projections], p), 6)
    return keys


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Rows of a batch whose vectors are equally long."""
    size = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, place (table), bucket of every vector in every table."""
    for batch in batches:
        for rows in _by_size(batch):
            for low in range(0, len(rows), 1024):
                some = batch.take(pa.array(rows[low : low + 1024]))
                unit = unit_vectors(_matrix(some["v"]))
                size = _U64(unit.shape[1])
                keys = mixed(bucket_keys(unit) ^ mixed(some["label"].to_numpy().astype(np.int64).view(_U64), 8)[:, None] ^ mixed(np.array([size]), 9), 10)
                rid, n = some["rid"].to_numpy(), keys.shape[1]
                columns = [np.repeat(rid, n), np.tile(np.arange(n, dtype=np.int32), len(rid)), keys.ravel().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "place", "bucket"])


def _small_pairs(vectors: np.ndarray, norm: np.ndarray, first: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with a cosine of ``least`` or more within many small groups at once."""
    rows = np.repeat(first, n) + within(n)
    fan = np.repeat(n, n) - 1 - within(n)
    if not fan.any():
        return
    step = max(1, _CELLS // vectors.shape[1])
    begin = np.searchsorted(np.cumsum(fan), np.arange(0, int(fan.sum()), step), "right")
    for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True):
        a = np.repeat(rows[low:high], fan[low:high])
        b = a + 1 + within(fan[low:high])
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= least
        yield a[near], b[near]


def _large_pairs(vectors: np.ndarray, norm: np.ndarray, first: int, n: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same within one large group, a block of rows against all."""
    span = slice(first, first + n)
    for low in range(first, first + n, _ROWS):
        left = slice(low, min(low + _ROWS, first + n))
        near = (vectors[left] @ vectors[span].T) / (norm[left, None] * norm[span]) >= least
        a, b = np.nonzero(near)
        a, b = a + low, b + first
        yield a[b > a], b[b > a]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label of their trees, in place; pairs that share one already go first."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        up = label[label]
        while (up != label).any():
            label[:] = up
            up = label[label]


def _compared(least: float):
    """a, b, links: for vectors with links to others, their number (b null); and links a, b that connect
    what is connected."""

    def groups(rows: pa.RecordBatch, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups of vectors of one length; ``key`` tells them apart."""
        if rows.num_rows < 2:
            return
        vectors = _matrix(rows["v"])
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norm = np.sqrt((vectors**2).sum(axis=1))
        rid, copies, chunk, place, one, two = (rows[c].to_numpy() for c in ("rid", "copies", "chunk", "place", "one", "two"))
        first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        n = np.diff(np.r_[first, len(rid)])
        small = n <= _SMALL

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from _small_pairs(vectors, norm, first[small], n[small], least)
            for f, many in zip(first[~small].tolist(), n[~small].tolist(), strict=True):
                yield from _large_pairs(vectors, norm, f, many, least)

        label, links = np.arange(len(rid)), np.zeros(len(rid), np.int64)
        for a, b in pairs():
            across = (one[a] == two[a]) | (chunk[a] != chunk[b])  # two chunks meet for the pairs across them
            a, b = a[across], b[across]
            if not len(a):
                continue
            involved, turn = np.unique(np.r_[a, b], return_inverse=True)
            keys = bucket_keys(vectors[involved] / norm[involved, None])
            shared = keys[turn[: len(a)]] == keys[turn[len(a) :]]
            here = shared.argmax(axis=1) == place[a]  # the first table they share
            a, b = a[here], b[here]
            links += np.bincount(a, copies[b], len(rid)).astype(np.int64) + np.bincount(b, copies[a], len(rid)).astype(np.int64)
            _merge(label, a, b)
        has, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rid)))
        if len(has):
            columns = [pa.array(np.r_[rid[has], rid[tied]]), pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(rid[label[tied]])])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.r_[links[has], np.zeros(len(tied), np.int64)])], names=["a", "b", "links"])

    def by_size(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = np.stack([batch[c].to_numpy().astype(np.int64) for c in _GROUP])
        for rows in _by_size(batch):
            yield from groups(batch.take(pa.array(rows)), key[:, rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy().astype(np.int64) for c in _GROUP])
            # The last group may go on in the next batch.
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and (key[:, 0] != last).any():
                yield from by_size(held)
                held = []
            cut = int(edges[-1]) if len(edges) else 0
            if cut:
                yield from by_size([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
            last = key[:, -1]
        if held:
            yield from by_size(held)

    return run


def near_vectors(embeddings: DataFrame, least: float = 0.93, together: int = TOGETHER) -> DataFrame:
    """vec_id, n_links, component_id, kept: rows linked by a cosine of ``least`` or more under one label.

    Vectors of one label (and length) are hashed by quantised random projections of their unit vectors, in
    ``TABLES`` tables; those that share a bucket are compared by exact cosine in double precision. n_links
    counts the other rows linked directly, component_id is the smallest vec_id reachable, itself included,
    kept says whether it is the row's own. A link at the threshold itself is found with a chance of 0.975,
    one at 0.95 or more with 0.996; none is below the threshold.

    A vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links
    with nothing. Rows with equal vectors and labels are copies of one node and count as linked. Rows with
    one vec_id are rows of their own; null vec_ids count as the largest number, and a component of them alone
    has component_id null. Extra columns are ignored; an empty table has no rows.

    Copies are reduced to one node on the map side, by 128 bits of hash. Only buckets with two vectors or
    more get the vectors, and only those are shuffled with them. A pair counts in the first table whose bucket
    it shares, so nothing is counted twice and no pair leaves its task: tasks give sums and spanning forests.
    A bucket of more than ``together`` vectors is dealt in chunks, and every two chunks meet in a task.
    """
    rows = pick(embeddings, vec_id="long", embedding="array<double>", label="long")
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(good & F.col("label").isNotNull(), F.lit(False))
    zeroed = F.transform(v, lambda x: x + F.lit(0.0))  # no negative zeros
    named = rows.select("vec_id", "label", F.when(valid, zeroed).alias("v"))
    h = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(s), "label", "v")).alias(n) for s, n in ((1, "h"), (2, "g"))]
    named = named.select("vec_id", "label", "v", *h)
    nodes = named.filter("v IS NOT NULL").groupBy("h", "g").agg(
        F.min(F.coalesce("vec_id", F.lit(_NO_ID))).alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    nodes = written(nodes.withColumn("rid", F.monotonically_increasing_id()), "vectors")

    keyed = written(nodes.select("rid", "label", "v").mapInArrow(_keyed, "rid long, place int, bucket long"), "buckets")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(shared, "bucket").groupBy("rid").agg(F.collect_list(F.struct("place", "bucket", "n")).alias("in"))
    chunks = F.ceil(F.col("n") / F.lit(together)).cast("int")
    dealt = nodes.join(members, "rid").select("rid", "label", "v", "copies", F.inline("in"))
    dealt = dealt.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rid", "bucket"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("one", F.least("chunk", "with")).withColumn("two", F.greatest("chunk", "with"))
    key = ["bucket", "one", "two"]
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key, "label", "place")
    columns = ["bucket", "label", "one", "two", "place", "chunk", "rid", "copies", "v"]
    found = written(sorted_.select(*columns).mapInArrow(_compared(least), "a long, b long, links long"), "links")

    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    member = components(found.filter("b IS NOT NULL").select("a", "b"))
    lows = nodes.select("rid", "low", "copies", "h", "g")
    rooted = member.join(lows.select("rid", "low"), member["node"] == F.col("rid")).select("rid", "root", "low")
    lowest = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("lowest")), "root").select("rid", "lowest")
    info = lows.join(linked, "rid", "left").join(lowest, "rid", "left").select(
        "h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("lowest")
    )
    out = named.select("vec_id", "h", "g").join(info, ["h", "g"], "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).when(F.col("lowest") != _NO_ID, F.col("lowest"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Stands for a null vec_id where the smallest is looked for.
_NO_ID = 2**63 - 1
