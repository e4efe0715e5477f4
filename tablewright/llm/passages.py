"""Passages repeated across documents, found by a count-min sketch of word windows and exact groups."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tablewright.llm.shared import LAST_ID, pick
from tablewright.llm.texts import Slice, Words, mixed, slices, span_hashes, windows, word_hashes, words

_U64 = np.uint64
#: Rows of the sketch, and the most bits of a cell number: two or three bitmaps of 32 MiB are the most
#: that is broadcast, and every worker holds them.
DEPTH = 2
MOST_BITS = 28
#: Cells of a block, the unit in which sketches are merged.
BLOCK_BITS = 22
#: Windows a task gathers before it hands out its part of the sketch.
FLUSH = 1_500_000
#: Bytes of text hashed at once; the arrays on the way take some fifty times as much.
_SLICE = 1 << 18
#: Groups of windows up to this estimate are put into one task whole; larger ones are aggregated first.
HOT = 4096


class Sketch:
    """For every row, whether a cell was counted at least twice; and of row 0, whether it is hot.

    It travels as the compressed blocks the tasks made and is unpacked, one bit a cell, where it is used.
    """

    def __init__(self, bits: int, block_bits: int, blocks: dict[tuple[int, int], tuple[bytes, bytes | None]]):
        self.bits, self.block_bits, self.blocks = bits, block_bits, blocks
        self.any_hot = any(often is not None for _, often in blocks.values())
        self._maps: list[np.ndarray] | None = None

    def __getstate__(self) -> tuple:
        return self.bits, self.block_bits, self.blocks

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)
        self._unpack(keep=False)

    def _unpack(self, keep: bool = True) -> list[np.ndarray]:
        if self._maps is None:
            step = (1 << self.block_bits) // 8
            self._maps = [np.zeros((1 << self.bits) // 8, np.uint8) for _ in range(DEPTH + self.any_hot)]
            for row, block in list(self.blocks):
                repeated, often = self.blocks[row, block] if keep else self.blocks.pop((row, block))
                span = slice(block * step, (block + 1) * step)
                self._maps[row][span] = np.frombuffer(zlib.decompress(repeated), np.uint8)
                if often is not None:
                    self._maps[DEPTH][span] = np.frombuffer(zlib.decompress(often), np.uint8)
        return self._maps

    def estimated_repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Places of windows whose estimated count is two or more: all that are, and a few that aren't."""
        left = np.arange(len(hashes))
        for row, bitmap in enumerate(self._unpack()[:DEPTH]):
            left = left[_bit(bitmap, _cells(hashes[left], row, self.bits))]
        return left

    def estimated_hot(self, hashes: np.ndarray) -> np.ndarray:
        if not self.any_hot:
            return np.zeros(len(hashes), bool)
        return _bit(self._unpack()[DEPTH], _cells(hashes, 0, self.bits))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(hashes, 20 + row) >> _U64(64 - bits)).astype(np.int64)


def _bit(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def _deltas(sorted_cells: np.ndarray) -> bytes:
    """Ascending numbers as steps of a byte each; 255 goes on 255 cells without counting one."""
    steps = np.diff(sorted_cells, prepend=0)
    far = steps // 255
    out = np.full(len(steps) + int(far.sum()), 255, np.uint8)
    out[np.arange(len(steps)) + np.cumsum(far)] = steps % 255
    return out.tobytes()


def _from_deltas(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps.astype(np.int64))[steps < 255]


def _window_hashes(part: Slice, found: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; first words and texts of the windows."""
    at, text = windows(found, width)
    return word_hashes(part.data, found), at, text


def _sparse_cells(batches: Iterator[pa.RecordBatch], width: int, bits: int, block_bits: int) -> Iterator[pa.RecordBatch]:
    """The cells of all windows of texts, for every row and block of the sketch as steps between sorted cells."""
    held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]

    def flush() -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            cells = np.concatenate(held[row])
            held[row].clear()
            cells.sort()
            block = (cells >> np.uint32(block_bits)).astype(np.int32)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            inside = np.uint32((1 << block_bits) - 1)
            parts = [_deltas((c & inside).astype(np.int64)) for c in np.split(cells, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(parts), pa.int32()), pa.array(block[first], pa.int32()), pa.array(parts, pa.binary())],
                names=["row", "block", "cells"],
            )

    for batch in batches:
        for part in slices(batch["text"], _SLICE):
            values, at, text = _window_hashes(part, words(part), width)
            hashes = span_hashes(values, at, at + width)
            order = np.argsort(hashes, kind="stable")  # windows of a text stay next to each other
            h, t = hashes[order], text[order]
            once = h[np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]] if len(h) else h
            for row in range(DEPTH):
                held[row].append(_cells(once, row, bits).astype(np.uint32))
            if sum(map(len, held[0])) >= FLUSH:
                yield from flush()
    if sum(map(len, held[0])):
        yield from flush()


def sketch_windows(docs: DataFrame, width: int, hot: int = HOT) -> Sketch:
    """Count-min sketch over the windows of all documents; each counts once per document.

    Every task sketches its own documents, sparsely: the sorted cells of its windows. Blocks of cells are
    merged by adding, one block at a time, so neither the tasks' memory nor the driver's depends on the
    number of tasks. There are four cells to a window or more, up to 2**28 in a row; beyond 65 million
    windows the bitmaps stay at that size, the estimate is looser, and more windows reach the exact groups.
    """
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(texts + 1))))
    block_bits = min(BLOCK_BITS, bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sparse_cells(batches, width, bits, block_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(0, np.uint32)

        def done() -> pa.RecordBatch:
            often = counts >= hot if current[0] == 0 else np.zeros(len(counts), bool)
            packed = [np.packbits(x, bitorder="little").tobytes() for x in (counts >= 2, often)]
            out = [pa.array([x], pa.int32()) for x in current] + [pa.array([zlib.compress(x, 1)], pa.binary()) for x in packed]
            return pa.RecordBatch.from_arrays([*out, pa.array([bool(often.any())])], names=["row", "block", "repeated", "often", "any"])

        for batch in batches:
            for row, block, cells in zip(*[batch[c].to_pylist() for c in ("row", "block", "cells")], strict=True):
                if (row, block) != current:
                    if current is not None:
                        yield done()
                    current, counts = (row, block), np.zeros(1 << block_bits, np.uint32)
                own = _from_deltas(cells)
                first = np.flatnonzero(np.diff(own, prepend=-1))
                counts[own[first]] += np.diff(np.r_[first, len(own)]).astype(np.uint32)
        if current is not None:
            yield done()

    parts = docs.select("text").mapInArrow(sketch, "row int, block int, cells binary")
    parts = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    merged = parts.mapInArrow(merge, "row int, block int, repeated binary, often binary, any boolean")

    blocks = {}
    for r in merged.toLocalIterator():
        blocks[r["row"], r["block"]] = (bytes(r["repeated"]), bytes(r["often"]) if r["any"] else None)
    return Sketch(bits, block_bits, blocks)


def _candidate_rows(batches: Iterator[pa.RecordBatch], known: Sketch, width: int, hot: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch["id"].to_numpy(), batch["tag"]
        for part in slices(batch["text"], _SLICE):
            found = words(part)
            values, at, text = _window_hashes(part, found, width)
            hashes = span_hashes(values, at, at + width)
            left = known.estimated_repeated(hashes)
            left = left[known.estimated_hot(hashes[left]) == hot]
            if not len(left):
                continue
            order = left[np.lexsort((text[left], hashes[left]))]
            h, t = hashes[order], text[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
            begin = (at[order] - found.first[t]).astype(np.int32)
            others = np.diff(np.r_[first, len(order)]) - 1
            rest = np.delete(begin, first)
            offsets = np.r_[0, np.cumsum(others)].astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[others == 0, False]), pa.array(rest))
            second = span_hashes(mixed(values, 3), at[order[first]], at[order[first]] + width, 1)
            row = t[first] + part.first
            out = (h[first].view(np.int64), (second >> _U64(32)).astype(np.uint32).view(np.int32), ids[row])
            rest = [tags.take(pa.array(row)), pa.array(begin[first]), more]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), *rest], names=["h", "g", "id", "tag", "place", "more"])


def _candidates(docs: DataFrame, sketch: Broadcast, width: int, hot: bool) -> DataFrame:
    """Windows estimated repeated (hot or not), one row to a document: 96 bits of hash, document, tag, first
    word; and, if the window comes more than once in its document, the first words of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _candidate_rows(batches, sketch.value, width, hot)

    kind = docs.schema["tag"].dataType.simpleString()
    return docs.mapInArrow(run, f"h long, g int, id long, tag {kind}, place int, more array<int>")


def repeated_windows(docs: DataFrame, width: int = 50, hot: int = HOT, unique: bool = False) -> DataFrame:
    """id, tag, places: first words of the windows of a document that also start in one with a smaller id.

    ``docs`` has id (long), tag and text; rows with one id and tag must have one text. Windows the sketch estimates repeated are grouped by 96 bits
    of hash, which settles what the sketch only suspected. Since the sketch never underestimates, a window
    that it doesn't call hot is in fewer than ``hot`` documents: such groups fit one task, and a window
    function finds their smallest id in one shuffle. Hot ones are reduced to their smallest id on the map
    side and joined back, which adaptive execution can split. Rows with one id and tag have one list between
    them, in which a place comes once, however many they are; with ``unique`` ids there are no such rows.
    """
    sketch = sketch_windows(docs, width, hot)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    group = Window.partitionBy("h", "g")
    few = _candidates(docs, shared, width, hot=False).withColumn("low", F.min("id").over(group))
    later = few.filter("id > low").select("id", "tag", "place", "more")
    if sketch.any_hot:
        many = _candidates(docs, shared, width, hot=True)
        lows = many.groupBy("h", "g").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("high")
        later = later.union(many.join(lows, ["h", "g"]).filter("id > low").select("id", "tag", "place", "more"))
    places = F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<int>")))
    if unique:
        return later.groupBy("id", "tag").agg(F.flatten(F.collect_list(places)).alias("places"))
    each = later.select("id", "tag", F.explode(places).alias("place")).distinct()
    return each.groupBy("id", "tag").agg(F.collect_list("place").alias("places"))


def _trimmed(docs: DataFrame, width: int, hot: int) -> DataFrame:
    """row (all columns of ``docs`` in a struct), kept (the words left), n_words, n_removed."""
    have = {c.lower(): c for c in docs.columns}
    text = docs[f"`{have['text']}`"].cast("string")
    named = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        F.coalesce(docs[f"`{have['doc_id']}`"].cast("long"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)).alias("tag"),  # 128 bits tell texts apart
        text.alias("text"),
    )
    unique = named.groupBy("id").count().filter("count > 1").isEmpty()
    if unique:
        named = named.withColumn("tag", F.lit(0))  # ids tell rows apart; nothing more has to be shuffled
    found = repeated_windows(named.select("id", "tag", "text"), width, hot, unique)
    joined = named.drop("text").join(found, ["id", "tag"], "left").select("row", "places")
    column = docs.columns.index(have["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["row"].field(column).cast(pa.string()), _SLICE):
                found = words(part)
                raw = part.data.tobytes()
                kept, removed = [], []
                for i, own in enumerate(batch["places"].slice(part.first, len(part))):
                    first, n = int(found.first[i]), int(found.counts[i])
                    stay = np.ones(n, bool)
                    if own.is_valid:
                        places = own.values.to_numpy()
                        assert len(places) == 0 or places.max() + width <= n, "places of another text"
                        cover = np.bincount(places, minlength=n + 1) - np.bincount(np.minimum(places + width, n), minlength=n + 1)
                        stay = np.cumsum(cover)[:n] <= 0
                    at = np.flatnonzero(stay) + first
                    kept.append(b" ".join([raw[a:b] for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist(), strict=True)]))
                    removed.append(n - len(at))
                out = [pa.array(kept, pa.binary()), pa.array(found.counts, pa.int64()), pa.array(removed, pa.int64())]
                own_rows = batch["row"].slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([own_rows, *out], names=["row", "kept", "n_words", "n_removed"])

    fields = [*joined.schema.fields[:1], StructField("kept", BinaryType())]
    fields += [StructField(n, LongType()) for n in ("n_words", "n_removed")]
    return joined.mapInArrow(run, StructType(fields)).withColumn("kept", F.col("kept").cast("string"))


def kept_words(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document.

    A word goes if a window of ``width`` words covers it whose word sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. Null texts have no words. Null doc_ids count as the
    largest number. Rows with one doc_id are not smaller than each other; each loses what its own text
    repeats. Texts shorter than the window lose nothing. Extra columns are ignored; no rows, no rows.
    """
    out = _trimmed(pick(docs, doc_id="long", text="string"), width, hot)
    return out.select("row.doc_id", "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, width: int = 50, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and n_chars brought in line. Texts that lose
    nothing stay byte for byte; a document of which nothing is left goes."""
    out = _trimmed(docs, width, hot).filter("n_removed = 0 or n_removed < n_words")

    def column(c: str) -> Column:
        own = F.col(f"row.`{c}`")
        if c.lower() == "text":
            return F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(own).alias(c)
        if c.lower() == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return out.select(*[column(c) for c in docs.columns])
