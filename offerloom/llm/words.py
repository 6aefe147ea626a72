"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D. Words and runs of
words get 64-bit polynomial hashes taken from prefix sums, so that the cost is
a few array operations a byte and never a Python call a word. The numbers
depend on content alone: every worker and every retry finds the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 250_000  # texts handled at once; a longer text is a chunk of its own
SLICE_ROWS = 512  # rows of a batch whose bytes are copied at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 2)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[key] = np.multiply.accumulate(table)
        if n > 4 * CHUNK_BYTES:  # tables of one very long text are not kept
            return _tables.pop("up")[:n], _tables.pop("down")[:n]
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of the rows first .. first + len(bounds) - 2 of a column."""

    first: int
    data: np.ndarray  # bytes of these rows
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i] .. bounds[i + 1]

    def row(self) -> np.ndarray:
        """Row, from 0, of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which `length` words of one row begin, and hashes of these runs."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(n) + length <= last)
        return at, self.spans(at, at + length)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences begin .. end."""
        up, down = _powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of a text column begin and end, and the bytes these places are in; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def words(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a text column, a few rows at a time; null counts as empty, lower folds A-Z."""
    for low in range(0, len(column), SLICE_ROWS):
        for part in _words(column.slice(low, SLICE_ROWS), lower, chunk):
            part.first += low
            yield part


def _words(column: pa.Array, lower: bool, chunk: int) -> Iterator[Words]:
    offsets, data = text_bytes(column)
    first = 0
    while first < len(column):
        stop = int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1
        stop = min(max(stop, first + 1), len(column))
        cut = offsets[first : stop + 1] - offsets[first]
        part = data[offsets[first] : offsets[stop]]
        if lower:
            part = _LOWER[part]
        space = _SPACE[part]
        before = np.ones(len(part), bool)  # a row or a white space ends just before
        before[1:] = space[:-1]
        before[cut[:-1][cut[:-1] < len(part)]] = True
        start = np.flatnonzero(before & ~space)
        after = np.ones(len(part), bool)
        after[:-1] = before[1:] | space[1:]
        end = np.flatnonzero(after & ~space) + 1
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        yield Words(first, part, start, end, hashes, np.searchsorted(start, cut))
        first = stop


def word_hashes(column: pa.Array) -> np.ndarray:
    """Hash of the whole bytes of each row of a text column, as of a word."""
    offsets, data = text_bytes(column)
    part = data[offsets[0] : offsets[-1]]
    up, down = _powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def distinct_by_row(hashes: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Ascending distinct hashes of each row; at: the word at which each hash begins."""
    cut = np.searchsorted(at, bounds)
    found = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = np.sort(hashes[lo:hi])
        if hi - lo > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        found.append(part)
    return found
