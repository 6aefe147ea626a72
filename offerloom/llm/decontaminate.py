"""Benchmark decontamination by greedy string tiling.

Items and documents are compared as words without case or ASCII punctuation.
Seeds are runs of five words: a rolling Karp-Rabin hash of every document
position is looked up in the seeds of all items. Where the seeds an item shares
with a document could cover enough of it, the pair is tiled: the longest match
of still unmarked words, at least five long, is marked on both sides, again and
again. The tiles' share of the item decides, so passages that were cut and
reordered count in full.

Items go to the executors as seed tables, a bounded block of items at a time;
documents are only ever mapped, never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.byte_bpe import groups
from offerloom.llm.shared import tidy
from offerloom.llm.words import Words, text_bytes, words

BLOCK_CHARS = 16_000_000  # of items that one pass over the documents tests
PART_BYTES = 1_000_000  # text folded at once; a longer text is a part of its own
SEED_BITS = 20


def fold(column: pa.Array) -> pa.Array:
    """Text with ASCII punctuation as spaces and ASCII and Latin-1 capitals folded."""
    offsets, data = text_bytes(column)
    raw = data[offsets[0] : offsets[-1]]
    out = _FOLDED[raw]
    wide = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][wide] += 0x20
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(out)])


def small(batches: Iterable[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about PART_BYTES of the text in a column."""
    for batch in batches:
        for first, stop in groups(pc.binary_length(batch.column(place)).fill_null(0).to_pylist(), PART_BYTES):
            yield batch.slice(first, stop - first)


_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def matches(starts_doc: np.ndarray, starts_item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, document start, item start) from shared seeds of `shortest` words."""
    slope = starts_doc - starts_item
    order = np.lexsort((starts_doc, slope))
    slope, at, item = slope[order], starts_doc[order], starts_item[order]
    new = np.ones(len(at), bool)
    new[1:] = (slope[1:] != slope[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return list(zip((count + shortest - 1).tolist(), at[first].tolist(), item[first].tolist(), strict=True))


def tile(found: list[tuple[int, int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, document start, item start): longest first, then earliest in the item, then in the document."""
    heap = [(-n, j, i) for n, i, j in found]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    tiles = []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = [k for k in range(-n) if i + k not in used_doc and j + k not in used_item]
        if len(free) == -n:
            tiles.append((-n, i, j))
            used_doc.update(range(i, i - n))
            used_item.update(range(j, j - n))
            continue
        run = 0
        for k, at in enumerate(free):  # what is left of the match comes back as shorter ones
            run += 1
            if k + 1 == len(free) or free[k + 1] != at + 1:
                if run >= shortest:
                    heapq.heappush(heap, (-run, j + at - run + 1, i + at - run + 1))
                run = 0
    return tiles


def _seed_table(items: list[tuple[int, str]], shortest: int):
    """Sorted seed hashes, with the item and the word of each, and the words of all items."""
    hashes, owner, at, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    base = 0
    for part in words(fold(pa.array([t for _, t in items], pa.large_string())), chunk=1 << 62):
        start, run = part.runs(shortest)
        row = np.searchsorted(part.bounds, start, "right") - 1
        hashes.append(run)
        owner.append(row + base)
        at.append(start - part.bounds[row])
        size.append(np.diff(part.bounds))
        base += len(part.bounds) - 1
    hashes, owner, at = (np.concatenate(x) for x in (hashes, owner, at))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owner[order], at[order], np.concatenate(size), [i for i, _ in items]


def _hits(part: Words, table, shortest: int, near: np.ndarray):
    """(row, item, document word, item word) of all shared seeds."""
    seeds = table[0]
    start, hashes = part.runs(shortest)
    keep = near[(hashes >> np.uint64(64 - SEED_BITS)).astype(np.int64)]
    start, hashes = start[keep], hashes[keep]
    low, high = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
    count = high - low
    start, low, count = start[count > 0], low[count > 0], count[count > 0]
    place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    start = np.repeat(start, count)
    row = np.searchsorted(part.bounds, start, "right") - 1
    return row, table[1][place], start - part.bounds[row], table[2][place]


def _near_seeds(table) -> np.ndarray:
    near = np.zeros(1 << SEED_BITS, bool)
    near[(table[0] >> np.uint64(64 - SEED_BITS)).astype(np.int64)] = True
    return near


def _found(column: pa.Array, table, near: np.ndarray, shortest: int, coverage: float):
    """(row, item, matched words, tiles) of each row and item whose tiles cover enough of the item."""
    size = table[3]
    for part in words(fold(column)):
        row, item, at, place = _hits(part, table, shortest, near)
        order = np.lexsort((item, row))
        row, item, at, place = row[order], item[order], at[order], place[order]
        turn = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
        edges = [0, *turn.tolist(), len(row)] if len(row) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            words_of = int(size[item[lo]])
            touched = np.zeros(words_of, bool)
            for k in range(shortest):
                touched[place[lo:hi] + k] = True
            if touched.sum() < coverage * words_of:
                continue
            tiles = tile(matches(at[lo:hi], place[lo:hi], shortest), shortest)
            matched = sum(n for n, _, _ in tiles)
            if matched >= coverage * words_of:
                yield part.first + int(row[lo]), int(item[lo]), matched, tiles


def _tested(shared, shortest: int, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.list_(pa.list_(pa.int32())))])

    def run(batches):
        table = shared.value
        size, names, near = table[3], table[4], _near_seeds(table)
        for batch in small(batches, 1):
            ids = batch.column(0)
            out: list[list] = [[] for _ in schema]
            for row, item, matched, tiles in _found(batch.column(1), table, near, shortest, coverage):
                made = (ids[row].as_py(), names[item], matched / int(size[item]), matched, int(size[item]), [list(t) for t in tiles])
                for column, value in zip(out, made, strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return tidy(run), "doc_id long, item_id long, coverage double, matched_words int, item_words int, tiles array<array<int>>"


def _seed_tables(benchmark: DataFrame, shortest: int):
    """Broadcast seed tables of the items, about BLOCK_CHARS characters each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_seed_table([tuple(r) for r in some], shortest))


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.8) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id,
    coverage (share of the item's words under tiles), matched_words, item_words,
    tiles ([length, document word, item word]).

    docs(doc_id, text, ...), benchmark(item_id, text, ...). Null, empty and blank
    texts match nothing, nor do items of fewer than `shortest` words. Repeated
    rows, repeated items and null ids give rows of their own. Other columns are
    not looked at. If either table is empty, so is the result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tested = []
    for shared in _seed_tables(benchmark, shortest):
        run, schema = _tested(shared, shortest, coverage)
        tested.append(narrow.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, tested)


def clean(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.8) -> DataFrame:
    """The rows of docs(text, ...), all columns, that hold no benchmark item as leaks() tells."""
    place = docs.columns.index("text")

    def kept(shared):
        def run(batches):
            near = _near_seeds(shared.value)
            for batch in small(batches, place):
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _found(batch.column(place), shared.value, near, shortest, coverage):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return tidy(run)

    for shared in _seed_tables(benchmark, shortest):
        docs = docs.mapInArrow(kept(shared), docs.schema)
    return docs
