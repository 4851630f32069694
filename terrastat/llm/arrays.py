"""Words, hashes and shingles of many texts at once, as numpy arrays inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The blanks of the word pattern ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def _multipliers(size: int, seed: int) -> np.ndarray:
    steps = np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def multipliers(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit factors, the same in every process."""
    size = 64
    while size < n:
        size *= 2
    return _multipliers(size, seed)[:n]


class Words(NamedTuple):
    """Words of consecutive texts joined by one blank: ``first[d]:first[d + 1]`` are those of text ``d``."""

    buffer: np.ndarray
    text_start: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One array of all texts, each followed by ``gap``, and where each starts (with the end)."""
    buffer = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buffer, at


def split_words(texts: list[bytes]) -> Words:
    buffer, at = joined(texts)
    inside = np.zeros(len(buffer) + 1, dtype=np.int8)
    inside[1:] = ~BLANK[buffer]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Words(buffer, at, starts, ends, np.searchsorted(starts, at))


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` (bytes) per range; ranges ascend and do not meet or overlap.

    Multilinear in the bytes with random odd factors by position, so two different ranges agree with a chance below 2**-56.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = ends - starts
    at = np.zeros(len(values), dtype=np.int64)
    total = int(length.sum())
    before = np.cumsum(length) - length
    at = np.arange(total) - np.repeat(before, length)
    where = at + np.repeat(starts, length)
    terms = (values[where].astype(np.uint64) + np.uint64(1)) * multipliers(int(length.max(initial=1)), seed)[at]
    filled = length > 0
    out = np.zeros(len(starts), dtype=np.uint64)
    if total:
        out[filled] = np.add.reduceat(terms, before[filled])
    return mix(out ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def word_hashes(w: Words, lower: bool = True) -> np.ndarray:
    return hash_ranges(LOWER[w.buffer] if lower else w.buffer, w.starts, w.ends)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (runs across texts included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    m = multipliers(k, 7)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * m[j]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text with their bounds; a text of 1 to k-1 words has one shingle, its whole sequence."""
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(first), dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    out = np.zeros(int(bounds[-1]), dtype=np.uint64)
    wide = window_hashes(hashes, k)
    long = counts >= k
    if long.any():
        n = sizes[long]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[step + np.repeat(bounds[:-1][long], n)] = wide[step + np.repeat(first[:-1][long], n)]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[first[d] : first[d + 1]]
        out[bounds[d]] = mix(np.array([(own * multipliers(k, 9)[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(len(own))]))[0]
    return out, bounds


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, a missing one as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with at most about ``limit`` bytes of text (one text alone may have more)."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and size + n > limit:
                part = batch.slice(start, i - start)
                yield part, as_bytes(part.column(column))
                start, size = i, 0
            size += n + 1
        if batch.num_rows:
            part = batch.slice(start)
            yield part, as_bytes(part.column(column))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.astype(np.uint64).view(np.int64))


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A two-dimensional array as one list per row."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))
