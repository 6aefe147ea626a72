"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product becomes nearest direction by one more component (vectors
scaled by the largest norm, padded to length one; queries padded by zero). Each
tree splits a bounded sample by planes midway between two of its points; every
row then walks down every tree. A query keeps one priority queue over all trees
and opens the most promising leaf, of any tree, until they hold a given share of
the index. Rows and queries meet in their leaves, where exact scores are taken
on the original vectors; the best of all leaves are the answer.

How large that share must be depends on the data: little for vectors in groups,
much for vectors without any structure. It is measured on the sample, against
all its pairs, for a recall of TARGET. Nearest rows of a larger table are nearer
than those of its sample, so the share errs on the safe side.

A leaf with many rows, or asked by many queries, is cut into a grid of bounded
tasks. Trees and leaf counts are bounded by the sample and travel to all tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.shared import stash

SAMPLE = 20_000  # rows that the trees are fitted on
TREES = 4
LEAF_ROWS = 8000  # aimed at, while the sample allows
LEAST_LEAF = 8  # sampled rows a leaf keeps
TARGET = 0.95  # of the nearest rows of a sampled query, found in the share of leaves it opens
PROBES = 300  # sampled queries that measure it
CELL_ROWS = 20_000  # rows, and queries, of one task's leaf cell at most, about


class Tree:
    """Planes and children of inner nodes; a child below zero is leaf -child - 1."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(points, leaf, rng)
        self.normals = np.array(self.normals, np.float32).reshape(len(self.normals), points.shape[1])
        self.offsets = np.array(self.offsets, np.float32)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, points, leaf, rng) -> int:
        work = [(points, None, 0)]
        root = 0
        while work:
            some, parent, side = work.pop()
            plane = self._plane(some, rng) if len(some) > leaf else None
            if plane is None:
                node = -self.leaves - 1
                self.leaves += 1
            else:
                node = len(self.normals)
                normal, offset, right = plane
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                work += [(some[~right], node, 0), (some[right], node, 1)]
            if parent is None:
                root = node
            else:
                self.children[parent][side] = node
        return root

    @staticmethod
    def _plane(points, rng):
        for _ in range(10):
            a, b = points[rng.integers(len(points), size=2)]
            normal = b - a
            size = np.linalg.norm(normal)
            if size < 1e-6:
                continue
            normal = normal / size
            height = points @ normal
            offset = float((a + b) @ normal / 2)
            right = height > offset
            if min(right.sum(), (~right).sum()) < len(points) / 20:
                offset = float(np.median(height))
                right = height > offset
            if 0 < right.sum() < len(points):
                return normal, offset, right
        return None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root, np.int64)
        while True:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                return -node - 1
            at = node[inner]
            right = np.einsum("ij,ij->i", points[inner], self.normals[at]) > self.offsets[at]
            node[inner] = self.children[at, right.astype(np.int64)]


class Forest:
    def __init__(self, points: np.ndarray, largest: float, rows: int):
        rng = np.random.default_rng(17)
        leaf = max(LEAST_LEAF, int(LEAF_ROWS * len(points) / max(rows, 1)))
        self.largest = largest
        padded = self.padded(points)
        self.trees = [Tree(padded, leaf, rng) for _ in range(TREES)]
        self.counts: list[np.ndarray] = []

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.largest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        return np.hstack([scaled, rest[:, None]]).astype(np.float32)

    def share(self, points: np.ndarray, k: int) -> float:
        """Share of the index that a query has to open, measured on the sample."""
        padded = self.padded(points)
        leaves = [t.leaf_of(padded) for t in self.trees]
        self.counts = [np.bincount(leaf, minlength=t.leaves) for leaf, t in zip(leaves, self.trees, strict=True)]
        found = []
        for i in np.random.default_rng(23).permutation(len(points))[:PROBES]:
            scores = points @ points[i]
            scores[i] = -np.inf
            best = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
            best = best[np.isfinite(scores[best])]
            when = np.full(len(best), np.inf)  # rows opened by the time that each is
            rows = 0
            for tree, leaf in self.opened(points[i], 1 << 62):
                rows += int(self.counts[tree][leaf])
                when = np.where(leaves[tree][best] == leaf, np.minimum(when, rows), when)
            found.append(when)
        found = np.concatenate(found) if found else np.zeros(0)
        return float(np.quantile(found, TARGET, method="higher")) / (TREES * len(points)) if len(found) else 1.0

    def opened(self, query: np.ndarray, search: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of one queue over all trees, until they hold `search` rows."""
        point = np.append(query / np.linalg.norm(query), 0).astype(np.float32)
        margins = [t.normals @ point - t.offsets for t in self.trees]
        queue = [(-np.inf, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        leaves, rows = [], 0
        while queue and rows < search:
            reach, k, node = heapq.heappop(queue)
            if node < 0:
                leaf = -node - 1
                if self.counts[k][leaf]:
                    leaves.append((k, leaf))
                    rows += int(self.counts[k][leaf])
                continue
            margin = float(margins[k][node])
            left, right = self.trees[k].children[node].tolist()
            heapq.heappush(queue, (max(reach, margin), k, left))
            heapq.heappush(queue, (max(reach, -margin), k, right))
        return leaves


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _walked(shared, kind: str):
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float32() if kind == "float" else pa.float64()))])

    def run(batches):
        forest = shared.value
        for batch in batches:
            if batch.num_rows:
                points = forest.padded(_matrix(batch.column(1)))
                for k, tree in enumerate(forest.trees):
                    leaf = tree.leaf_of(points)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf.astype(np.int32)), batch.column(0), batch.column(1)], schema=schema)

    return run, f"tree int, leaf int, vec_id long, vector array<{kind}>"


def _asked(shared, search: int, kind: str):
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float32() if kind == "float" else pa.float64()))])

    def run(batches):
        forest = shared.value
        for batch in batches:
            tree, leaf, place = [], [], []
            for i, query in enumerate(_matrix(batch.column(1)) if batch.num_rows else []):
                for k, at in forest.opened(query, search):
                    tree.append(k)
                    leaf.append(at)
                    place.append(i)
            take = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], schema=schema)

    return run


def _best(k: int):
    """One cell's queries against its rows: the k best of each query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        asked = queries.column("vec_id").to_numpy()
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        base = _matrix(rows.column("vector").combine_chunks())[order]
        vectors = _matrix(queries.column("vector").combine_chunks())
        out = []
        for i in range(0, len(asked), 64):
            rough = vectors[i : i + 64] @ base.T
            rough[asked[i : i + 64, None] == ids] = -np.inf
            for j, row in enumerate(rough):
                if len(row) > k:  # rounding must not part ties
                    edge = np.partition(row, len(row) - k)[len(row) - k]
                    some = np.flatnonzero((row >= edge - 1e-9 * (1 + abs(edge))) & np.isfinite(row))
                else:
                    some = np.flatnonzero(np.isfinite(row))
                # one order of summing for every pair, so that equal vectors score the same everywhere
                scores = (base[some] * vectors[i + j]).sum(axis=1)
                best = np.lexsort((ids[some], -scores))[:k]
                out.append(pa.table([np.full(len(best), asked[i + j]), ids[some][best], scores[best]], schema=schema))
        return pa.concat_tables(out).combine_chunks()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of vectors(vec_id, embedding, ...) with the largest inner product found for
    each of queries(vec_id, embedding, ...): query_id, rank, vec_id, score; ties to the smaller vec_id.

    A query never finds its own vec_id. Vectors without id, null, zero, or with
    a null or non-finite component, take no part; nor do those whose length is
    not the most frequent one. Of rows that repeat a vec_id, the one with the
    least vector counts. Other columns are not looked at. Empty tables give an
    empty result. Scores are exact; which rows are found is approximate.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
        finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN compares above infinity
        return df.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))

    rows = usable(vectors)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    answer = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], answer)
    rows = rows.filter(F.size("vector") == size["size"])
    queries = usable(queries).filter(F.size("vector") == size["size"])
    rows = stash(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, largest = rows.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    share = 2.0 * SAMPLE / count
    drawn = rows.withColumn("key", F.xxhash64("vec_id", F.lit(3))).filter(F.expr(f"pmod(key, 1000000000) < {share * 1e9:.0f}"))
    drawn = drawn.orderBy("key", "vec_id").limit(SAMPLE).select("vector").collect()
    points = np.array([r["vector"] for r in drawn], np.float64).reshape(len(drawn), -1)
    forest = Forest(points, largest * (1 + 1e-9), count)
    search = int(np.ceil(forest.share(points, k) * TREES * count))
    run, schema = _walked(spark.sparkContext.broadcast(forest), kind)
    index = stash(rows.mapInArrow(run, schema))
    counts = index.groupBy("tree", "leaf").agg(F.count("*").alias("rows"))
    forest.counts = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for row in counts.collect():  # as many as leaves
        forest.counts[row["tree"]][row["leaf"]] = row["rows"]
    asked = stash(queries.mapInArrow(_asked(spark.sparkContext.broadcast(forest), search, kind), schema))

    # a grid over each leaf: rows in `r` parts, queries in `q` parts, every part meeting every other once
    grid = asked.groupBy("tree", "leaf").agg(F.count("*").alias("asks")).join(counts, ["tree", "leaf"])
    grid = grid.select("tree", "leaf", F.expr(f"1 + rows div {CELL_ROWS}").alias("r"), F.expr(f"1 + asks div {CELL_ROWS}").alias("q"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(grid, ["tree", "leaf"])
        return df.withColumn(own + "_part", F.expr(f"pmod(xxhash64(vec_id), {own})")).withColumn(other + "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("r", "q")

    cell = ["tree", "leaf", "r_part", "q_part"]
    best = dealt(asked, "q", "r").groupBy(*cell).cogroup(dealt(index, "r", "q").groupBy(*cell)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
