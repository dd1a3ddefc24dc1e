"""Words of many texts at once: numpy arrays over the bytes of an Arrow column, for use inside tasks.

A word is a maximal run of bytes that are not ASCII white space (0x20, 0x09-0x0D). All hashes wrap
modulo 2**64; equal words have equal hashes, whatever their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are handled at once; a longer text makes a chunk of its own. Some arrays take eight bytes for each, several
# at a time, in every worker process of an executor.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A 64-bit value per byte; with ``fold_case`` A-Z count as a-z."""
    code = np.arange(256, dtype=np.uint64)
    if fold_case:
        upper = (code >= 65) & (code <= 90)
        code = np.where(upper, code + np.uint64(32), code)
    return mix(code + np.uint64(1 + 1000 * seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _kept_powers(base: int) -> np.ndarray:
    return powers(base, CHUNK_BYTES + 1)


class Rolling:
    """Hashes of stretches of one array from running sums, each in constant time.

    The value of ``values[s:e]`` is its sum with weights base**0, base**1 ...: the stretch of the
    running sum, divided by base**s. An odd base has an inverse modulo 2**64.
    """

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        n, undo = len(values), pow(base, -1, 1 << 64)
        weights, self.undo = (_kept_powers(b)[: n + 1] if n <= CHUNK_BYTES else powers(b, n + 1) for b in (base, undo))
        np.cumsum(values * weights[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.undo[start] + (end - start).astype(np.uint64))

    def each(self, size: int) -> np.ndarray:
        """Of all stretches of one size."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.undo[:n] + np.uint64(size))


@dataclass
class Words:
    """Words of a chunk of texts. Text i has the words first[i] to first[i + 1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0, fold_case: bool = False) -> np.ndarray:
        return Rolling(byte_values(seed, fold_case)[self.data]).of(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """The starts, as word numbers, of all windows of k words within a text."""
        n = len(self.start)
        last = np.repeat(self.first[1:], self.counts())
        return np.flatnonzero(np.arange(n) + k <= last)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def split_words(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    data, offsets = text_bytes(column)
    for low, high in chunks(offsets, limit):
        part = data[offsets[low] : offsets[high]]
        bounds = offsets[low : high + 1] - offsets[low]
        solid = ~((part == 32) | ((part >= 9) & (part <= 13)))
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = bounds[:-1][bounds[:-1] < len(part)]
        begins[inner] |= solid[inner]
        inner = bounds[1:][bounds[1:] > 0] - 1
        ends[inner] |= solid[inner]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(low, part, bounds, start, end, np.searchsorted(start, bounds))
