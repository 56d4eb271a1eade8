"""Tokens, hashes and size-checked joins that the operators share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a word: space and 0x09-0x0D. ``bytes.split()`` uses the same six.
SPACES = "\\x20\\x09-\\x0D"
#: Text that one step inside a task handles together; a longer text is a step of its own.
PIECE_BYTES = 8_000_000
#: A side with at most this many narrow rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches where the text in ``column`` passes ``limit``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def bytes_of(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.large_binary()).to_pylist()


class Words:
    """The words of several texts as numbers into one vocabulary. Text i owns codes[bounds[i]:bounds[i + 1]]."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, sequences: bool = False):
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        codes, bounds = [np.empty(0, np.int64)], [0]
        whole: list[int] = []
        for text in texts:
            words = (text.lower() if lower else text).split() if text else ()
            if sequences:
                whole.append(sequence_hash(words))
            codes.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            bounds.append(bounds[-1] + len(words))
        self.codes = np.concatenate(codes)
        self.bounds = np.array(bounds, np.int64)
        self.vocabulary = list(index)
        self.sequences = np.array(whole, np.uint64)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.lengths)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, in text order."""
        return hashed(self.vocabulary)[self.codes] if self.vocabulary else np.empty(0, np.uint64)


def sequence_hash(words: Sequence[bytes]) -> int:
    """64-bit hash of a whole word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def hashed(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    x = a * _K1 + ((b << np.uint64(31)) | (b >> np.uint64(33))) * _K2
    x ^= x >> np.uint64(32)
    x *= _K3
    x ^= x >> np.uint64(29)
    return x


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbours, built by doubling: about 2 log2(width) passes."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    total, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            total = power if total is None else mix(total[: len(h) - done - size + 1], power[done:])
            done += size
        if done == width:
            return total[: len(h) - width + 1]
        power = mix(power[:-size], power[size:])
        size *= 2


def starts_in(words: Words, width: int) -> np.ndarray:
    """For each word: whether a run of ``width`` words that starts there stays in its text."""
    position = np.arange(len(words.codes))
    return position + width <= np.repeat(words.bounds[1:], words.lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a table that was written already if its counted rows are few; leave the join to the planner otherwise."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; rows without an id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
