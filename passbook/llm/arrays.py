"""Words, grams and hashes of a block of texts as numpy arrays; runs inside tasks.

A text is a span of one byte array, so a block of documents needs no Python object per
word. Words are the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashes are 64 bits
wide: a polynomial in the bytes, mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; one longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

GOLDEN = 0x9E3779B97F4A7C15
ODD = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers of a seed."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    return mix(at + np.uint64(seed * 0x2545F4914F6CDD1D % 2**64))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks."""
    return sys.modules.setdefault("_passbook_worker", types.ModuleType("_passbook_worker")).__dict__


class Texts:
    """A block of texts: ``data`` holds the bytes, text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def get(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The block of an Arrow column of strings; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[bounds[0] : bounds[-1]], bounds - bounds[0])


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    column = batch.column(text)
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
    part = (np.cumsum(size) - 1) // most
    start = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of a block: ``start`` and ``end`` bytes, ``doc`` index, ``hash``."""

    def __init__(self, start, end, doc, hash_):
        self.start, self.end, self.doc, self.hash = start, end, doc, hash_

    def __len__(self) -> int:
        return len(self.start)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each of the ascending, disjoint, non-empty byte spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.zeros(int(size.sum()), np.int64)
    at = np.cumsum(size) - size
    first[at] = start
    first[at[1:]] -= end[:-1] - 1
    first[1:][first[1:] == 0] = 1
    index = np.cumsum(first)
    place = np.arange(len(index)) - np.repeat(at, size)
    power = _powers(int(size.max()))
    value = numbers(256, 1)[data[index]] * power[place]
    total = np.add.reduceat(value, at)
    return mix(total + size.astype(np.uint64) * np.uint64(GOLDEN))


def _powers(n: int) -> np.ndarray:
    """1, m, m**2, ... modulo 2**64."""
    out = np.ones(max(1, n), np.uint64)
    done, factor = 1, ODD
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(factor)
        done, factor = done + more, factor * factor % 2**64
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(texts: Texts, lower: bool = False) -> Words:
    """All words in order; ``lower`` folds A-Z before hashing."""
    data, bounds = texts.data, texts.bounds
    inside = ~is_space(data)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    start[edge] |= inside[edge]
    end[edge - 1] |= inside[edge - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    doc = np.searchsorted(bounds, first, side="right") - 1
    return Words(first, last, doc, span_hashes(data, first, last))


def grams(words: Words, n: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of one document, and the index of the first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = numbers(n, seed) | np.uint64(1)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += words.hash[k : k + m] * factor[k]
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return mix(total[at]), at
