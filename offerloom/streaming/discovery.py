"""Discovery as a stream that can be stopped and taken up at the next page.

A crawl writes the pages of a run (source, keyword, work mode) in order. Each run
has a cursor: the last page taken, and whether the run has ended, by a page without
a next one or by the source's cap. A micro-batch takes what lies after the cursor, up
to the end, and writes one digest row a url. Pages that are read again after a resumed
crawl, and pages past the end, add nothing.

Digests and cursors are one folder a batch, merged now and then: a batch that is run
again finds what it found before and replaces what it wrote. The offers table is not
rewritten per batch; ``discovery.upsert`` folds the current digest into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from offerloom import schemas
from offerloom.operators.discovery import RUN, crawled_pages, digest, merge_digests, page_cap, sightings
from offerloom.streaming.batches import NUMBER, Batches

MERGE_EVERY = 20  # batches after which the folders become one
DIGEST = "url_hash string, url string, source string, keywords array<string>, first_at timestamp, last_at timestamp"


def crawl_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.CRAWL_RESULTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


class Discovery:
    """Tables of a running discovery below one shared folder. ``run``: the columns that name a run."""

    def __init__(self, spark: SparkSession, root: str, run: list[str] | None = None):
        self.run = run or RUN
        cursor = T.StructType([T.StructField(c, T.StringType()) for c in self.run])
        cursor = cursor.add("page", T.IntegerType()).add("ended", T.BooleanType())
        self.digests = Batches(spark, f"{root}/digests", DIGEST)
        self.cursors = Batches(spark, f"{root}/cursors", cursor)

    @staticmethod
    def _merged(digests: DataFrame) -> DataFrame:
        return merge_digests(digests.withColumnRenamed(NUMBER, "batch"))

    def _furthest(self, cursors: DataFrame) -> DataFrame:
        return cursors.groupBy(*self.run).agg(F.max("page").alias("page"), F.max("ended").alias("ended"))

    def current(self) -> DataFrame:
        """One digest row a url, for ``discovery.upsert``."""
        return self._merged(self.digests.read())

    def cursor(self) -> DataFrame:
        """Each run's last page and whether it has ended; a crawl goes on after that page."""
        return self._furthest(self.cursors.read())

    def advance(self, crawl: DataFrame, number: int) -> None:
        if number and number % MERGE_EVERY == 0:
            self.digests.merge(number - 1, self._merged)
            self.cursors.merge(number - 1, self._furthest)
        at = self._furthest(self.cursors.read(number)).select(
            *[F.col(c).alias(f"_{c}") for c in self.run], F.col("page").alias("_page"), F.col("ended").alias("_ended"))
        same = F.lit(True)
        for c in self.run:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        ahead = F.col("_page").isNull() | (~F.col("_ended") & (F.col("page") > F.col("_page")))
        taken = crawled_pages(crawl.join(at, same, "left").where(ahead).select(*crawl.columns), self.run)
        last = ~F.coalesce(F.col("has_next_page"), F.lit(False)) | (F.col("page") >= page_cap(F.col("source")))
        moved = taken.groupBy(*self.run).agg(F.max("page").alias("page"), F.max(last).alias("ended"))
        self.digests.write(digest(sightings(taken)), number)
        self.cursors.write(moved, number)


def start_discovery(
    crawl: DataFrame, root: str, checkpoint: str, run: list[str] | None = None, available_now: bool = True
) -> StreamingQuery:
    def advance(batch: DataFrame, number: int) -> None:
        Discovery(batch.sparkSession, root, run).advance(batch, number)

    writer = crawl.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
