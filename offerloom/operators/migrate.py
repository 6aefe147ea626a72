"""Reshapes of stored tables, each with its way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions.arrays import array_from_json, array_to_json, iso, step_time, steps_from_columns

STEP_COLUMNS = {
    "discovery": "first_seen_at", "fetch": "fetched_at", "enrich": "enriched_at",
    "score": "scored_at",
}


def columns_to_steps(rows: DataFrame) -> DataFrame:
    """Four timestamp columns -> steps_details."""
    steps = steps_from_columns({s: iso(F.col(c)) for s, c in STEP_COLUMNS.items()})
    return rows.withColumn("steps_details", steps).drop(*STEP_COLUMNS.values())


def steps_to_columns(rows: DataFrame) -> DataFrame:
    steps = F.col("steps_details")
    return rows.withColumns(
        {c: step_time(steps, s) for s, c in STEP_COLUMNS.items()}
    ).drop("steps_details")


def mode_from_remote(remote: Column) -> Column:
    return (
        F.when(remote == "yes", "remote").when(remote == "no", "on-site")
        .when(remote == "hybrid", "hybrid")
    )


def remote_from_mode(mode: Column) -> Column:
    return (
        F.when(mode == "remote", "yes").when(mode == "on-site", "no")
        .when(mode == "hybrid", "hybrid")
    )


def technologies_to_arrays(rows: DataFrame) -> DataFrame:
    names = ("primary_technologies", "secondary_technologies")
    return rows.withColumns({n: array_from_json(F.col(n)) for n in names})


def technologies_to_json(rows: DataFrame) -> DataFrame:
    names = ("primary_technologies", "secondary_technologies")
    return rows.withColumns({n: array_to_json(F.col(n)) for n in names})


def pages_to_store(offers: DataFrame, raw_pages: DataFrame) -> DataFrame:
    """HTML kept in the offers table that the page store does not hold yet."""
    return (
        offers.where(F.col("html_content") != "")
        .join(raw_pages.select("url_hash"), "url_hash", "left_anti")
        .select("url_hash", "url", "source", F.col("html_content").alias("html"))
    )


def pages_to_column(offers: DataFrame, raw_pages: DataFrame) -> DataFrame:
    stored = raw_pages.select("url_hash", F.col("html").alias("html_content"))
    return offers.drop("html_content").join(stored, "url_hash", "left")
