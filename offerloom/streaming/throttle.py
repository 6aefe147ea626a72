"""Status notices: at most one per key and second.

The second starts at the notice, not on a grid: after a notice at t the next one
is the first event at t + 1000 ms or later.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerloom.fixed_values import STATUS_THROTTLE_MS
from offerloom.sources.tables import stash

CHUNK_MS = 3_600_000
FAN_IN = 32  # chunks, and nodes, that one node of the tree stands for
LEVELS = 3
NEVER = -(1 << 62)  # earlier than any time


def notices(times: Sequence[int], free_from: int, gap: int = STATUS_THROTTLE_MS) -> list[int]:
    """Notice times for sorted event times, nothing allowed before free_from."""
    out, at = [], bisect_left(times, free_from)
    while at < len(times):
        out.append(int(times[at]))
        at = bisect_left(times, out[-1] + gap, at)
    return out


def hand_over(times: Sequence[int], start: int, gap: int = STATUS_THROTTLE_MS) -> tuple[list[int], list[int]]:
    """What a chunk does to the time from which its key is free, as steps.

    Free from ``starts[i]``, or later but before ``starts[i + 1]``, the chunk leaves the key free from
    ``ends[i]``. Only when the key becomes free within the chunk's first second makes a difference.
    All starts go through the chunk together; those that meet at a notice go on as one.
    """
    times = np.asarray(times, "int64")
    free = np.concatenate(([start], times[: np.searchsorted(times, start + gap)] + 1))
    starts, one = free, np.arange(len(free))  # the place in `free` that each start has come to
    at = np.searchsorted(times, free)
    while len(times) and at[0] < len(times):  # an earlier start is never behind a later one
        live = at < len(times)
        free = np.where(live, times[np.minimum(at, len(times) - 1)] + gap, free)
        at = np.searchsorted(times, free)
        new = np.concatenate(([True], free[1:] != free[:-1]))
        free, at, one = free[new], at[new], (np.cumsum(new) - 1)[one]
    ends = free[one]
    kept = np.concatenate(([True], ends[1:] != ends[:-1]))
    return starts[kept].tolist(), ends[kept].tolist()


def step(starts, ends, free_from: int) -> int:
    """The time that a step function gives; before its first step, that of the first."""
    return int(ends[max(0, bisect_right(starts, free_from) - 1)])


def composed(parts) -> tuple[list[int], list[int]]:
    """Step functions (starts, ends) one after the other, as one."""
    starts, ends = parts[0]
    starts, ends = list(starts), list(ends)
    for next_starts, next_ends in parts[1:]:
        ends = [step(next_starts, next_ends, e) for e in ends]
    kept = [i for i, e in enumerate(ends) if i == 0 or e != ends[i - 1]]
    return [starts[i] for i in kept], [ends[i] for i in kept]


def distinct_times(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Distinct times, ascending: eight bytes each, folded together when as many again have come."""
    times, waiting, size = np.empty(0, "int64"), [], 0
    for part in parts:
        waiting.append(part)
        size += len(part)
        if size > max(len(times), 100_000):
            times, waiting, size = np.unique(np.concatenate([times, *waiting])), [], 0
    return np.unique(np.concatenate([times, *waiting]))


def throttled(events: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """(key, ts) of the notices, exact for a key of any size.

    Events are cut into hour chunks of distinct milliseconds, so the largest
    group is bounded by the clock and not by the number of events. What a chunk
    passes to the next one is a step function "free from -> free from" of at most
    a thousand steps. Functions are composed by FAN_IN up a tree of chunks, and
    the time from which a key is free is handed down again: no row holds more than
    FAN_IN functions, however many years a key has. Then every chunk is replayed
    with its true starting point.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    chunks = stash(  # read on the way up and for the replay
        events.select(F.col(key).alias("key"), ms.alias("ms"))
        .withColumn("chunk", F.floor(F.col("ms") / CHUNK_MS))
        .groupBy("key", "chunk")
        .agg(F.sort_array(F.collect_set("ms")).alias("times"))
    )
    key_type = dict(chunks.dtypes)["key"]
    node = f"key {key_type}, node long, starts array<long>, ends array<long>"

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [hand_over(t, c * CHUNK_MS) for c, t in zip(batch["chunk"], batch["times"])]
            yield pd.DataFrame({
                "key": batch["key"], "node": batch["chunk"],
                "starts": [s for s, _ in steps], "ends": [e for _, e in steps]})

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [composed([(p["starts"], p["ends"]) for p in parts]) for parts in batch["parts"]]
            yield pd.DataFrame({
                "key": batch["key"], "node": batch["parent"],
                "starts": [s for s, _ in steps], "ends": [e for _, e in steps]})

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row_key, parts, free in zip(batch["key"], batch["parts"], batch["free"]):
                for part in parts:
                    rows.append((row_key, part["node"], free))
                    free = step(part["starts"], part["ends"], free)
            yield pd.DataFrame(rows, columns=["key", "node", "free"])

    def families(nodes: DataFrame, fan_in: int) -> DataFrame:
        return nodes.withColumn("parent", F.floor(F.col("node") / fan_in)).groupBy("key", "parent").agg(
            F.sort_array(F.collect_list(F.struct("node", "starts", "ends"))).alias("parts"))

    nodes = chunks.mapInPandas(leaves, node)
    levels = []
    for _ in range(LEVELS):
        levels.append(stash(families(nodes, FAN_IN)))  # read on the way up and on the way down
        nodes = levels[-1].mapInPandas(up, node)
    # a node of the last level covers almost four years
    top = nodes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "starts", "ends"))).alias("parts"))
    free = top.withColumn("free", F.lit(NEVER)).mapInPandas(down, f"key {key_type}, node long, free long")
    for family in reversed(levels):
        handed = family.join(free.withColumnRenamed("node", "parent"), ["key", "parent"])
        free = handed.select("key", "parts", "free").mapInPandas(down, f"key {key_type}, node long, free long")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = [notices(times, free) for times, free in zip(batch["times"], batch["free"])]
            yield pd.DataFrame({"key": batch["key"], "sent": sent})

    return (
        chunks.join(free.withColumnRenamed("node", "chunk"), ["key", "chunk"])
        .select("key", "times", "free")
        .mapInPandas(replay, f"key {key_type}, sent array<long>")
        .select(F.col("key").alias(key), F.explode("sent").alias("_ms"))
        .select(key, F.timestamp_millis("_ms").alias(ts))
    )


def throttled_stream(events: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """The same rule over a stream; the state per key is one time.

    Each task first reduces its events to distinct milliseconds, so a hot key
    sends at most a thousand rows per second of event time to its state.
    """
    narrow = events.select(
        F.col(key).cast("string").alias("key"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"),
    )

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    def emit(
        group: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        free_from = state.get[0] if state.exists else 0
        sent = notices(distinct_times(batch["ms"].astype("int64").to_numpy() for batch in batches), free_from)
        if sent:
            state.update((sent[-1] + STATUS_THROTTLE_MS,))
        yield pd.DataFrame({"key": [group[0]] * len(sent), "ms": sent})

    return (
        narrow.mapInPandas(distinct, "key string, ms long")
        .groupBy("key")
        .applyInPandasWithState(
            emit, "key string, ms long", "free_from long", "append",
            GroupStateTimeout.NoTimeout,
        )
        .select(F.col("key").alias(key), F.timestamp_millis("ms").alias(ts))
    )
