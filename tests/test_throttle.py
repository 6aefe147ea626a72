import datetime as dt
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from offerloom.plans import catalog_rules
from offerloom.plans.catalog import CATALOG
from offerloom.plans.catalog_rules import hourly_notices
from offerloom.plans.views import table
from offerloom.streaming.throttle import CHUNK_MS, FAN_IN, composed, distinct_times, hand_over, notices, step, throttled

EPOCH = dt.datetime(1970, 1, 1)


def brute(times):
    sent = []
    for t in sorted(times):
        if not sent or t - sent[-1] >= 1000:
            sent.append(t)
    return sent


def test_second_starts_at_the_notice():
    assert notices([0, 400, 999, 1000, 1500, 2100], 0) == [0, 1000, 2100]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20_000), max_size=60))
def test_notices_equal_brute_force(times):
    assert notices(sorted(set(times)), 0) == brute(set(times))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4999), max_size=40), min_size=1, max_size=5), st.integers(-10, 999))
def test_composed_steps_equal_replaying_the_chunks(chunks, free_from):
    """Chunks of five seconds that hand over."""
    parts, times = [], []
    for n, offsets in enumerate(chunks):
        own = sorted({n * 5000 + t for t in offsets})
        times += own
        if own:
            parts.append(hand_over(own, n * 5000))
    if not parts:
        return
    whole = composed(parts)
    assert len(whole[0]) <= 1001 and all(a != b for a, b in zip(whole[1], whole[1][1:]))
    sent = notices(times, free_from)
    border = len(chunks) * 5000  # what the next chunk can tell apart
    assert max(border, step(*whole, free_from)) == max(border, sent[-1] + 1000 if sent else free_from)


def test_ten_years_of_one_key(spark):
    rng = random.Random(3)
    centres = [CHUNK_MS * h for h in range(400_000, 400_000 + 87_600, 11)]
    times = {c + rng.randint(-1500, 1500) for c in centres for _ in range(6)}
    rows = [("k", EPOCH + dt.timedelta(milliseconds=t)) for t in times]
    found = throttled(spark.createDataFrame(rows, "key string, ts timestamp")).select(F.unix_millis("ts")).collect()
    assert sorted(r[0] for r in found) == brute(times)
    assert FAN_IN * 1001 * 2 * 8 < 1_000_000  # the longest row


def test_chunks_chain_exactly(spark):
    """Dense events across many chunk borders, one key with most of the rows."""
    rng = random.Random(11)
    events = []
    for border in range(1, 6):
        centre = border * CHUNK_MS
        events += [("hot", centre + rng.randint(-4000, 4000)) for _ in range(400)]
        events += [(f"k{border}", centre + rng.randint(-1500, 1500)) for _ in range(5)]
    events += [("hot", CHUNK_MS * 2 + 500_000 + 37 * i) for i in range(2000)]
    rows = [(k, EPOCH + dt.timedelta(milliseconds=t)) for k, t in events]
    found = throttled(spark.createDataFrame(rows, "key string, ts timestamp")).collect()
    by_key = {}
    for r in found:
        ms = round((r["ts"] - EPOCH).total_seconds() * 1000)
        by_key.setdefault(r["key"], []).append(ms)
    for key in {k for k, _ in events}:
        assert sorted(by_key[key]) == brute({t for k, t in events if k == key}), key


def test_registered_row_hands_over_between_hours(spark, small_tables):
    """Some notices are held back only because of one in the hour before."""
    events = catalog_rules.hourly_notices(spark.read.parquet(f"{small_tables}/events.parquet"))
    given = {}
    for r in events.select("key", F.unix_millis("ts").alias("ms")).distinct().collect():
        given.setdefault(r.key, {}).setdefault(r.ms // CHUNK_MS, []).append(r.ms)
    assert all(len(chunks) > 24 for chunks in given.values())
    apart = {(key, t) for key, chunks in given.items() for times in chunks.values() for t in notices(sorted(times), 0)}
    sent = {tuple(r) for r in CATALOG["throttle"].run(spark, small_tables).collect()}
    assert apart - sent
    assert sent == {(key, t) for key, chunks in given.items() for t in brute({t for times in chunks.values() for t in times})}


def test_times_of_a_key_are_eight_bytes_each():
    parts = [np.arange(70_000) % 50_000, np.arange(40_000, 100_000), np.array([7, 7, 3]), np.empty(0, "int64")]
    times = distinct_times(iter(parts))
    assert times.dtype == np.int64 and times.nbytes == 8 * 100_000
    assert times.tolist() == sorted({int(t) for p in parts for t in p})
    sent = notices(times, 10)
    assert sent == notices(times.tolist(), 10) and all(type(t) is int for t in sent)
    assert distinct_times(iter([])).tolist() == []


def test_events_are_spread_before_they_multiply(spark, small_tables):
    plan = hourly_notices(table(spark, small_tables, "events"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("hashpartitioning(event_id")


def test_events_are_read_once(spark):
    """The replay takes the chunks that the way up has read."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(500).select(F.lit("k").alias("key"), F.timestamp_millis(F.col("id") * 700).alias("ts"))
    events = rows.mapInPandas(counted, "key string, ts timestamp")
    assert throttled(events).count() == 250
    assert read.value == 500


def test_starts_that_meet_go_on_as_one():
    """A chunk as the tasks get it, a numpy array, against one replay a start."""
    rng = np.random.default_rng(3)
    for size, span in ((0, 10), (1, 10), (300, 400), (400, 5000), (60, 40000), (3000, 3000)):
        times = np.unique(rng.integers(7000, 7000 + span, size))
        starts, ends = hand_over(times, 7000)
        for free in (7000, 7001, 7200, 7500, 7999):
            sent = notices(times.tolist(), free)
            if sent:
                assert ends[max(i for i, s in enumerate(starts) if s <= free)] == sent[-1] + 1000
