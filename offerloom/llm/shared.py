"""Helpers of the operators: shared scratch tables and bounded broadcasts."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir.

    Only where none is named and the session runs on one machine, as in tests, a temporary one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="offerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files of queries that are made and run inside go when each has ended, not when the driver happens
    to collect its garbage. Make no DataFrame inside that is run again: its shuffles would be made anew."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def stash(df: DataFrame) -> DataFrame:
    """The rows written to a shared table and read back: later jobs, and retries
    after a lost executor, start from these files."""
    path = scratch_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Removes the files of a table of stash() that nothing will read again."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """A function of a task's batches after which Arrow and the C library give back to the system what they
    have kept: Python workers stay for later tasks, beside others."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim is not None:
            trim(0)

    return whole


def version(text: Column) -> Column:
    """32 bits of a text's hash: tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


MAX_BITMAP_BITS = 27  # 16 MB; a larger set only raises the share of false positives


def bitmap(keys: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter over the only column (64-bit hashes) of `keys`.

    What reaches the driver is bounded by the filter's size, 16 MB, whatever the input.
    False positives cost work, never results: users group exactly afterwards.
    """
    name = keys.columns[0]
    keys = keys.select(F.col(name).alias("k"))
    with shuffles_go(keys.sparkSession):
        bits = min(MAX_BITMAP_BITS, max(16, math.ceil(math.log2(32 * keys.count() + 2))))
        place = F.shiftrightunsigned("k", 64 - bits)
        words = (
            keys.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % f"shiftrightunsigned(k, {64 - bits})").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits"))
            .toArrow()  # no Python object for each word
        )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be in the filter."""
    bits = np.uint64(len(table).bit_length() - 1 + 6)
    place = hashes >> (np.uint64(64) - bits)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
