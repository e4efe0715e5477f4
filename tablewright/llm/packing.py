"""Tokenised documents cut into pieces of binary lengths, one piece to a sequence."""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import pick, written
from tablewright.llm.texts import _BYTES, Slice, slices, span_hashes, within

#: Distinct chunks a worker remembers before it starts afresh.
REMEMBERED = 1_000_000

#: Most rows of part, length and number of pieces that are broadcast, about 24 bytes each.
MOST_SENT = 1_000_000

#: First bytes after a space at which no cut is made: white space, and the UTF-8 lead bytes of characters
#: that may be white space.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[:33] = True
_NO_CUT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Fixed value: how a byte-level pre-tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(tokenizer):
    """The same vocabulary for the faster merge loop of ``tiktoken``, if its ids stand in order of the merges."""
    import tiktoken

    config = json.loads(tokenizer.to_str())
    splitting, model = config["pre_tokenizer"] or {}, config["model"]
    plain = splitting.get("type") == "ByteLevel" and splitting.get("use_regex") and not splitting.get("add_prefix_space")
    if not plain or config["normalizer"] or model.get("type") != "BPE" or model.get("dropout"):
        return None
    vocabulary = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in printable}
    symbol |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    merged = [*[t for t, i in vocabulary.items() if i < 256], *[a + b for a, b in pairs]]
    ranks = {bytes(symbol[c] for c in token): vocabulary[token] for token in merged}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts by a byte-level tokenizer of the ``tokenizers`` library.

    Its pattern never joins a character to a following space, and a space goes with the character after it.
    So a text may be cut before every space that stands before a visible character, and the pieces encoded
    one by one: the ids are those of the whole text. Each distinct piece is encoded once and remembered by
    a hash of 128 bits.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]  # one character is one byte
        self.ranked = _ranked(self.tokenizer)
        self.specials = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Known chunks by rising first hash, with the second hash and the chunk's place in ``first``."""
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def chunk_ids(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and how many each text has."""
        data, offsets, n = part.data, part.offsets, len(part)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & ~_NO_CUT[data[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] = False  # the space that ends a text has nothing after it
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)]
        raw = data.tobytes()
        if any(s in raw for s in self.specials) or not _is_text(raw):
            return self._whole(raw, offsets)
        h = span_hashes(_BYTES[0][data], starts, ends, 0)
        keys, where, turn = np.unique(h, return_index=True, return_inverse=True)
        g = span_hashes(_BYTES[1][data], starts, ends, 1)
        checks = g[where]
        if (checks[turn] != g).any():
            return self._whole(raw, offsets)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if (self.checks[at[known]] != checks[known]).any():
            return self._whole(raw, offsets)
        place = np.empty(len(keys), np.int64)
        place[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            spans = where[new]
            ids, lengths = self._encode([raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            place[new] = len(self.first) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.checks = np.insert(self.checks, at[new], checks[new])
            self.places = np.insert(self.places, at[new], place[new])
        chunk = place[turn]
        sizes = self.first[chunk + 1] - self.first[chunk]
        ids = self.ids[np.repeat(self.first[chunk], sizes) + within(sizes)]
        totals = np.r_[0, np.cumsum(sizes)]
        return ids, np.diff(totals[np.searchsorted(starts, offsets)])

    def _encode(self, chunks: list[bytes], together: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks. Those a cut made are encoded many at a time and told apart by the bytes of the ids."""
        glued = np.fromiter((len(c) > 1 and c[0] == 32 and not _NO_CUT[c[1]] for c in chunks), bool, len(chunks))
        lengths, parts = np.zeros(len(chunks), np.int64), []
        order = np.flatnonzero(glued)
        for k in range(0, len(order), together):
            some = order[k : k + together]
            own = [chunks[i] for i in some.tolist()]
            found = np.array(self._ids(b"".join(own).decode()), np.uint32)
            reached, ends = np.cumsum(self.width[found]), np.cumsum([len(c) for c in own])
            last = np.searchsorted(reached, ends)
            assert (reached[last] == ends).all(), "the tokenizer is not byte-level"
            lengths[some] = np.diff(last, prepend=-1)
            parts.append(found)
        for i in np.flatnonzero(~glued).tolist():
            found = np.array(self._ids(chunks[i].decode()), np.uint32)
            lengths[i] = len(found)
            parts.append(found)
        ids = np.concatenate(parts)
        order = np.concatenate([order, np.flatnonzero(~glued)])
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return ids[np.repeat(start, lengths) + within(lengths)], lengths

    def _ids(self, text: str) -> list[int]:
        if self.ranked is not None:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the cache: for slices that hold a special token's text, or colliding hashes."""
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(e) for e in each], np.int64)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_lengths(n: int, most: int) -> list[int]:
    """n as pieces of the full length, then the powers of two in the rest, the largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Tokenised pieces of binary length: doc_id, start, length, ids_crc32, doc_tokens, part, place, ids
    (little-endian unsigned 32-bit numbers; null unless ``with_ids``).

    A document is its ids and ``end_id``. It is cut into as many full pieces as fit and one piece for every
    power of two in the remainder, so no piece needs padding and none crosses documents. ``most`` must be a
    power of two. part is the task's partition, place the piece's number among those of its length there.
    Null and empty texts are the end id alone. Null doc_ids stay null, rows with one doc_id are documents of
    their own, extra columns are ignored, and an empty table has no pieces. A text is tokenised whole,
    however long. ``tokenizer`` is the path of a file that every executor has.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        places: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch["text"]):
                ids, counts = encode.chunk_ids(part)
                out_ids = np.empty(len(ids) + len(counts), "<u4")
                out_ids[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                out_ids[np.cumsum(counts) + np.arange(len(counts))] = end_id
                tokens = counts + 1
                raw, base = out_ids.tobytes(), 0
                rows: list[tuple] = []
                for i, n in enumerate(tokens.tolist()):
                    start = 0
                    for length in binary_lengths(n, most):
                        body = raw[4 * (base + start) : 4 * (base + start + length)]
                        rows.append((i, start, length, zlib.crc32(body), n, task, places[length], body if with_ids else None))
                        places[length] += 1
                        start += length
                    base += n
                owner, *columns = zip(*rows, strict=True)
                own = batch["doc_id"].slice(part.first, len(part)).take(pa.array(owner))
                kinds = [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long, ids binary"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pick(docs, doc_id="long", text="string").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """The pieces as sequences in buckets of equal length: ``pieces`` and sequence_id, offset (always 0).

    sequence_ids run from 0 without gaps, the longest bucket first, so a training job that wants batches of
    one length takes a range of ids. The pieces are written once: a piece's number is its place in its part,
    behind the pieces of greater length and those of its length in earlier parts. These are sums over a row
    for each part and length. Up to ``MOST_SENT`` such rows, which are counted first, go to the pieces by
    broadcast; more are joined by shuffle.
    """
    found = written(pieces(docs, tokenizer, most, end_id, with_ids), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row for each binary length
    longer = longer.select("length", F.coalesce(F.sum("n").over(earlier.orderBy(F.desc("length"))), F.lit(0)).alias("longer"))
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("length").orderBy("part")), F.lit(0))
    before = counts.withColumn("inside", inside).join(longer, "length").select("part", "length", (F.col("longer") + F.col("inside")).alias("ahead"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    joined = found.join(F.broadcast(before) if counts.count() <= MOST_SENT else before, ["part", "length"])
    return joined.select(*columns, (F.col("ahead") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
