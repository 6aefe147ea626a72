"""Substring dedup by exact matching of 20-word windows.

This stands in for a greedy relative Lempel-Ziv parse: the factors below are
merged copied windows.

The reference is the whole corpus, cut into blocks by content: each window of
20 words names as its seed the 8-word block with the least hash in it, so equal
windows name equal blocks at equal places. Consecutive windows with one seed
occurrence form a block context of up to 32 words. All contexts are indexed
by seed:

* a seed met once belongs to no repeat;
* occurrences of one seed with one and the same context copy the earliest of
  them, as a whole: factors that lie inside a repeated passage;
* where a seed stands in different contexts, a factor ends somewhere near; its
  windows are checked one by one against the earliest equal window.

Adjoining copied windows of a document join to its factors, and the
words under them are removed. A window is copied only from an earlier place of
the input (smaller doc_id, or same document and earlier start), whatever
happens to that place itself.

Seeds, contexts and windows are compared by 64-bit hashes, always two at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.shared import bitmap, in_bitmap, stash, version
from offerloom.llm.words import Words, words

BLOCK = 8  # words of a seed
NO_ID = -(1 << 63)  # stands for a null doc_id, so that such rows come first


def _seeds(part: Words, window: int):
    """Starts of the windows, and of each window the start and hash of its seed (leftmost of equal ones)."""
    at, _ = part.runs(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    n = len(part.hash)
    blocks = np.arange(n - BLOCK + 1)
    hashes = part.spans(blocks, blocks + BLOCK)
    best, reach, wanted = blocks, 1, window - BLOCK + 1
    while reach < wanted:  # leftmost minimum of `reach` blocks, doubled until it spans the window
        step = min(reach, wanted - reach)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[left] <= hashes[right], left, right)
        reach += step
    seed = best[at]
    return at, seed, hashes[seed]


def _contexts(window: int):
    """(doc_id, version, text) -> a row for each block context."""
    schema = pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int32()), ("start", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in words(batch.column(2)):
                at, seed, hashes = _seeds(part, window)
                if not len(at):
                    continue
                first = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1))))
                last = np.concatenate((first[1:], [len(at)])) - 1
                row = np.searchsorted(part.bounds, at[first], "right") - 1
                context = part.spans(at[first], at[last] + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[first].view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[part.first + row]), pa.array(versions[part.first + row]),
                     pa.array((at[first] - part.bounds[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], schema=schema)

    return run, "seed long, context long, doc_id long, version int, start int, windows int"


def _windows(window: int, chosen):
    """(doc_id, version, text) -> a row for each window whose seed may stand in several contexts."""
    schema = pa.schema([("seed", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int32()), ("start", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for part in words(batch.column(2)):
                at, _, hashes = _seeds(part, window)
                keep = in_bitmap(chosen.value, hashes)
                if not keep.any():
                    continue
                at, hashes = at[keep], hashes[keep]
                row = np.searchsorted(part.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(part.spans(at, at + window).view(np.int64)), pa.array(ids[part.first + row]), pa.array(versions[part.first + row]),
                     pa.array((at - part.bounds[row]).astype(np.int32)), pa.array(np.ones(len(at), np.int32))], schema=schema)

    return run


def _copies(batches):
    """Of rows ordered by (seed, context, doc_id, start): those later than the first of their (seed, context),
    and each first one that begins a second context of its seed (mixed)."""
    schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int32()), ("start", pa.int32()), ("windows", pa.int32()), ("mixed", pa.bool_())])
    top = None  # (seed, context, doc_id, start) of the first row of the group that the last row belongs to
    for batch in batches:
        seed, context, doc, _, start, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(seed):
            continue
        same_seed = np.concatenate(([top is not None and top[0] == seed[0]], seed[1:] == seed[:-1]))
        same = same_seed & np.concatenate(([top is not None and top[1] == context[0]], context[1:] == context[:-1]))
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(seed))))
        inside = lead >= 0
        lead_doc = np.where(inside, doc[lead], top[2] if top else 0)
        lead_start = np.where(inside, start[lead], top[3] if top else 0)
        later = same & ((doc != lead_doc) | (start != lead_start))
        mixed = same_seed & ~same
        keep = pa.array(later | mixed)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(mixed)], schema=schema)
        yield out.filter(keep)
        top = (seed[-1], context[-1], lead_doc[-1], lead_start[-1])


def _kept(window: int):
    """(doc_id, n_spans arrays, text) -> words, removed words and what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("factors", pa.list_(pa.list_(pa.int32())))])

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            offsets = spans.offsets.to_numpy()
            first = spans.values.field("start").to_numpy(zero_copy_only=False)
            count = spans.values.field("windows").to_numpy(zero_copy_only=False)
            n, removed, kept, factors, size = [], [], [], [], 0
            done = 0
            for i, text in enumerate(batch.column(1)):
                tokens = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                lo, hi = offsets[i], offsets[i + 1]
                n.append(len(tokens))
                if hi > lo:
                    edge = np.zeros(len(tokens) + 1, np.int32)
                    np.add.at(edge, first[lo:hi], 1)
                    np.add.at(edge, first[lo:hi] + count[lo:hi] + window - 1, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                    factors.append(turn.reshape(-1, 2).tolist())
                    removed.append(int(covered.sum()))
                    tokens = [tokens[j] for j in np.flatnonzero(~covered).tolist()]
                else:
                    factors.append([])
                    removed.append(0)
                kept.append(b" ".join(tokens))
                size += len(kept[-1])
                if size > 16_000_000 or i == batch.num_rows - 1:
                    ids = batch.column(0).slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept), pa.array(factors, pa.list_(pa.list_(pa.int32())))], schema=schema)
                    n, removed, kept, factors, size, done = [], [], [], [], 0, i + 1

    return run, "doc_id long, n_words long, n_removed long, kept binary, factors array<array<int>>"


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept (UTF-8 of
    the words left, joined by one space), factors (removed word spans [begin, end)).

    window is at least 8. A null or empty text, or one of white space, has no
    words. A text shorter than the window loses nothing. Rows that repeat a
    doc_id count as one document place: what starts at the same doc_id and
    word is not earlier, so identical rows keep their words, and later windows
    of a longer variant are judged by their starts. A null doc_id comes before
    all others. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), version(text).alias("version"), text.alias("text"))
    run, schema = _contexts(window)
    copied = "seed long, doc_id long, version int, start int, windows int, mixed boolean"
    index = narrow.mapInArrow(run, schema).repartition("seed").sortWithinPartitions("seed", "context", "doc_id", "start")
    whole = stash(index.mapInArrow(_copies, copied))
    chosen = spark.sparkContext.broadcast(bitmap(whole.filter("mixed").select("seed").distinct()))
    checked = narrow.mapInArrow(_windows(window, chosen), schema)
    checked = checked.repartition("seed", "context").sortWithinPartitions("seed", "context", "doc_id", "start").mapInArrow(_copies, copied)
    spans = whole.union(checked).filter("not mixed").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    run, schema = _kept(window)
    empty = F.array().cast("array<struct<start:int,windows:int>>")
    joined = narrow.join(spans, ["doc_id", "version"], "left")
    out = joined.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("text"), F.coalesce("spans", empty).alias("spans"))
    return out.mapInArrow(run, schema)

