"""Hard negatives by a secondary sort of pair scores.

Rows meet anchors in cells of bounded size: rows in parts, anchors in parts,
every part meeting every other once. What a cell emits is bounded by its
anchors: first the best rows of each anchor's own label, of which the anchor's
positives are chosen; then, for each window that a positive opens, the best rows
of other labels inside it. No pair that an answer holds is lost, and copies of a
vector, or a label of a third of all rows, make a cell emit no more.

Candidates are dealt by anchor and sorted inside their partitions by (anchor,
descending score, kind, id), the shuffle and sort spilling to disk as they need.
An iterator then reads each anchor once from its best pair down: a positive opens
its window, a negative is written under every open window that it lies in, and a
window closes when it is full or the scores have left it. The iterator holds the
open windows of one anchor, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.shared import stash

CELL_ROWS = 20_000  # rows, and anchors, of one cell, about
STRIPE = 2_000_000  # scores held at once
FLUSH = 10_000  # answers written at once

LONG = np.iinfo(np.int64)
PAIR = pa.schema([("anchor_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("positive", pa.bool_())])
FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; those that leave 64 bits end at the least or largest number."""
    size = a.shape[1] * max(1, int(np.abs(a.astype(float)).max(initial=0))) * max(1, int(np.abs(b.astype(float)).max(initial=0)))
    if size < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if size < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """The k places among `some` with the highest scores, ties to the smaller id."""
    if len(some) > k:
        part = scores[some]
        some = some[part >= np.partition(part, len(part) - k)[len(part) - k]]
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~: descending, without overflow


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _in_cell(choose):
    """Calls choose(place of the anchor, its scores, labels, ids, own place or none) for each anchor of a cell."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return PAIR.empty_table()
        left, right = _matrix(anchors), _matrix(rows)
        anchor_ids = anchors.column("vec_id").to_pylist()
        anchor_labels = anchors.column("label").to_pylist()
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        windows = anchors.column("windows").to_pylist() if "windows" in anchors.column_names else None
        out: list[tuple] = []
        step = max(1, STRIPE // len(ids))
        for low in range(0, len(left), step):
            for i, scores in enumerate(products(left[low : low + step], right), low):
                own = labels == anchor_labels[i]
                best = choose(scores, ids, own & (ids != anchor_ids[i]), ~own, windows[i] if windows else None)
                out.append((np.full(len(best), anchor_ids[i]), scores[best], ids[best], own[best]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), PAIR.types, strict=True)], schema=PAIR)

    return run


def _positives(k: int):
    return _in_cell(lambda scores, ids, same, other, windows: first_of(scores, ids, np.flatnonzero(same), k))


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest whole score within low and high hundredths of a positive's."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def choose(scores, ids, same, other, windows):
        found = [np.zeros(0, np.int64)]
        cuts = [bounds(w, low, high) for w in windows]
        near = np.flatnonzero(other & (scores >= max(LONG.min, min(c[0] for c in cuts)))) if cuts else found[0]
        for least, most in cuts:
            inside = scores[near]
            # compared as whole numbers that fit, whatever the window
            least, most = min(max(least, LONG.min), LONG.max), min(max(most, LONG.min), LONG.max)
            found.append(first_of(scores, ids, near[(inside >= least) & (inside <= most)], k) if least <= most else found[0])
        return np.unique(np.concatenate(found))

    return _in_cell(choose)


def _windows(positives: int, negatives: int, low: int, high: int):
    """Sorted pairs to answers: opens, fills and closes the windows of one anchor after the other."""

    def run(batches):
        anchor, opened, seen = None, [], 0  # a window: positive, its score, how many negatives it has
        out: list[tuple] = []
        for batch in batches:
            for anchor_id, score, vec_id, positive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor_id != anchor:
                    anchor, opened, seen = anchor_id, [], 0
                if positive:
                    if seen < positives:
                        seen += 1
                        opened.append([vec_id, score, 0])
                    continue
                opened = [w for w in opened if w[2] < negatives and 100 * score >= low * w[1]]
                for w in opened:
                    if 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], vec_id, w[1], score))
            while len(out) >= FLUSH:
                yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, o, strict=True)) for o in out[:FLUSH]], schema=FOUND)
                out = out[FLUSH:]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, o, strict=True)) for o in out], schema=FOUND)

    return run


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of anchors(vec_id) among vectors(vec_id, label, vector array<long>, ...).

    A score is the inner product with the anchor. An anchor's positives are its first other rows of
    its label; for each, the first rows of other labels whose score lies within `low` and `high`
    hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Higher scores come first, ties by smaller vec_id. `high` is 100 at most.

    Rows with a null id, label, vector or component take no part, nor do anchors that are no such
    row. Of rows that repeat a vec_id, the one with the least label, then vector, counts. Vectors
    meet others of their length only. Scores beyond 64 bits stop at the least or largest number.
    Other columns are not looked at. Empty tables give an empty result.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(F.forall("vector", lambda x: x.isNotNull()))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")
    rows = stash(rows.withColumn("size", F.size("vector")))
    asked = stash(rows.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"))
    n_rows, n_asked = rows.count(), asked.count()
    spark = vectors.sparkSession
    # at least as many cells as the session has cores, so that small tables are spread as well
    q = 1 + n_asked // CELL_ROWS
    r = max(1 + n_rows // CELL_ROWS, -(-spark.sparkContext.defaultParallelism // q))
    cell = ["size", "q", "r"]

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(own, F.expr(f"pmod(xxhash64(vec_id), {parts})").cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    cells = dealt(rows, "r", r, "q", q).groupBy(*cell)
    kinds = "anchor_id long, score long, vec_id long, positive boolean"
    near = dealt(asked, "q", q, "r", r).groupBy(*cell).cogroup(cells).applyInArrow(_positives(positives), kinds)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    chosen = stash(chosen.select("anchor_id", "score", "vec_id", "positive"))
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("windows"))  # a few an anchor
    windowed = asked.join(windows, "vec_id")
    far = dealt(windowed, "q", q, "r", r).groupBy(*cell).cogroup(cells).applyInArrow(_negatives(negatives, low, high), kinds)
    keyed = chosen.unionByName(far).repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), F.desc("positive"), "vec_id")
    return keyed.mapInArrow(_windows(positives, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
