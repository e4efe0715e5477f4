"""Words and hashes of many texts at once, as numpy arrays over one byte buffer.

These run inside tasks, on the Arrow batches that Spark hands out. A batch is cut into slices of a few
megabytes, so the memory in use depends on the slice and the longest document, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U64 = np.uint64

#: Separators of words: ASCII space and the characters 9 to 13.
SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Slice:
    """Consecutive rows first..first+n of a batch: bytes of their texts and n+1 offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, rows: int = 512) -> Iterator[Slice]:
    """Texts (null: empty) in slices of at most ``rows`` texts and ``limit`` bytes, or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for low in range(0, len(texts), rows):
        some = texts.slice(low, rows).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(some):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield Slice(low + first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


@dataclass
class Words:
    """Words of a slice: byte spans, and for every text the index of its first word (n+1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(part: Slice, separates: np.ndarray = SEPARATES) -> Words:
    inside = ~separates[part.data]
    n = len(inside)
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[0] = closes[n] = True
    opens[1:n] = closes[1:n] = ~inside[:-1] if n else False
    closes[1:n] = ~inside[1:] if n else False
    opens[part.offsets] = closes[part.offsets] = True
    starts = np.flatnonzero(opens[:n] & inside)
    ends = np.flatnonzero(closes[1:] & inside) + 1
    return Words(starts, ends, np.searchsorted(starts, part.offsets))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x + _U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _power(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base, and of its inverse modulo 2**64."""
    have = _powers.get(seed)
    if have is None or len(have[0]) <= n:
        base = _BASES[seed]
        inverse = pow(base, -1, 2**64)
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, _U64), np.full(size, inverse, _U64)
        up[0] = down[0] = 1
        have = _powers[seed] = (np.cumprod(up), np.cumprod(down))
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand: prefix sums of a
    polynomial modulo 2**64, shifted back to power zero and mixed."""
    up, down = _power(seed, len(values))
    sums = np.zeros(len(values) + 1, _U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mixed(raw ^ mixed((ends - starts).astype(_U64), 7), seed)


_BYTES = tuple(mixed(np.arange(256, dtype=_U64), 11 + s) for s in range(2))


def word_hashes(data: np.ndarray, found: Words, seed: int = 0) -> np.ndarray:
    return span_hashes(_BYTES[seed][data], found.starts, found.ends, seed)


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and texts of all runs of ``width`` words inside one text."""
    counts = np.maximum(found.counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return within(counts) + np.repeat(found.first[:-1], counts), text


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every text, in how many of its hashes each bit is set: (texts, 64), bit 0 first.

    ``hashes`` holds counts[0] hashes of the first text, then counts[1] of the second, and so on. Eight lanes
    of eight bits are added at once, in runs of at most 255 so that no lane overflows.
    """
    out = np.zeros((len(counts), 64), np.int64)
    if not len(hashes):
        return out
    runs = (counts + 254) // 255
    owner = np.repeat(np.arange(len(counts)), runs)
    start = np.repeat(np.cumsum(counts) - counts, runs) + 255 * within(runs)
    lane = _U64(0x0101010101010101)
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for bit in range(8):
        sums = np.add.reduceat((hashes >> _U64(bit)) & lane, start)
        per_run = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[owner[firsts], bit::8] = np.add.reduceat(per_run, firsts, axis=0)
    return out
