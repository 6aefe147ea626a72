"""Live job status: how many jobs are queued and running now.

A stream of job runs tells every state a job goes through. What counts is each job's
latest state, so a new state takes the one before it back: a micro-batch looks up
what is known of its jobs, turns every change into -1 for the old state and +1 for
the new one, and adds the sums to the counts of the batch before. Jobs live in a log
of narrow rows, merged now and then; the counts are one row a batch.

Rows of one job may come late or twice: the latest ``at`` counts, at equal times the
later state, and older ones change nothing. A batch that is run again finds and
writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.operators.metrics import JOB_PREFIX, job_class
from offerloom.streaming.batches import Batches

MERGE_EVERY = 50  # batches after which the log's folders become one
ORDER = ("queued", "running", "done")
JOBS = "job string, place struct<at: timestamp, step: int>"
COUNTS = "queued_count long, running_count long, updated_at timestamp"


def places(job_runs: DataFrame) -> DataFrame:
    """(job, place) of our jobs' runs; a state that is neither queued nor running is an end."""
    ours = job_runs.where(job_class(F.col("item")).startswith(JOB_PREFIX) & F.col("job").isNotNull())
    step = F.when(F.col("state") == ORDER[0], 0).when(F.col("state") == ORDER[1], 1).otherwise(2)
    return ours.select(
        F.col("job").cast("string").alias("job"), F.struct("at", step.alias("step")).alias("place"))


class LiveStatus:
    """Tables of a running status below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jobs = Batches(spark, f"{root}/jobs", JOBS)
        self.counts = Batches(spark, f"{root}/counts", COUNTS)

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job").agg(F.max("place").alias("place"))

    def advance(self, job_runs: DataFrame, number: int) -> None:
        if number and number % MERGE_EVERY == 0:
            self.jobs.merge(number - 1, self._latest)
        new = self._latest(places(job_runs))
        known = self.jobs.read(number).join(new.select("job"), "job", "left_semi")
        old = self._latest(known).select(F.col("job"), F.col("place").alias("before"))
        moved = new.join(old, "job", "left").where(F.col("before").isNull() | (F.col("place") > F.col("before")))
        moved = self.jobs.write(moved.select("job", "place"), number)
        step, before = F.col("place.step"), F.col("before.step")

        def change(value: int) -> Column:
            return F.sum((step == value).cast("long") - F.coalesce((before == value).cast("long"), F.lit(0)))

        changes = moved.join(old, "job", "left").agg(
            change(0).alias("queued_count"), change(1).alias("running_count"), F.max("place.at").alias("updated_at"))
        total = self.counts.last(number).unionByName(changes).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("queued_count", "running_count")],
            F.max("updated_at").alias("updated_at"))
        self.counts.write(total, number)
        self.counts.forget(number - 1)

    def current(self, now: Column | None = None) -> DataFrame:
        """One row: active, queued_count, running_count, updated_at. Without any job the idle row."""
        last = max((n for _, n in self.counts.folders()), default=-1)
        counts = self.counts.last(last + 1).agg(
            *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("queued_count", "running_count")],
            F.max("updated_at").alias("updated_at"))
        at = F.col("updated_at") if now is None else now
        active = F.col("queued_count") + F.col("running_count") > 0
        return counts.select(active.alias("active"), "queued_count", "running_count", at.alias("updated_at"))


def start_status(
    job_runs: DataFrame, root: str, checkpoint: str, available_now: bool = True,
    push: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Keeps the status of a stream of (job, state, item, at); ``push`` gets the row after every batch."""

    def advance(batch: DataFrame, number: int) -> None:
        status = LiveStatus(batch.sparkSession, root)
        status.advance(batch, number)
        if push is not None:
            push(status.current())

    writer = job_runs.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
