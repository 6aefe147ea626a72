"""Dashboard figures and job status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.fixed_values import JOB_PREFIX


def dashboard_totals(offers: DataFrame) -> DataFrame:
    """All totals in one pass over the offers (rejected ones included)."""
    steps = F.col("steps_details")
    return offers.agg(
        F.count("*").alias("total"),
        F.count_if(F.map_contains_key(steps, "fetch")).alias("fetched"),
        F.count_if(F.map_contains_key(steps, "enrich")).alias("enriched"),
        F.count_if(F.map_contains_key(steps, "score")).alias("scored"),
        F.round(F.avg("score"), 1).alias("average_score"),
    )


def top_sources(offers: DataFrame, k: int = 5) -> DataFrame:
    return (
        offers.groupBy("source").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "source").limit(k)
    )


def dashboard(offers: DataFrame) -> DataFrame:
    """One row: the totals and the top sources as an array.

    The per-source counts (one small row per source) carry partial sums of every
    total, so a single grouped pass over the offers feeds both.
    """
    steps = F.col("steps_details")
    per_source = offers.groupBy("source").agg(
        F.count("*").alias("count"),
        F.count_if(F.map_contains_key(steps, "fetch")).alias("fetched"),
        F.count_if(F.map_contains_key(steps, "enrich")).alias("enriched"),
        F.count_if(F.map_contains_key(steps, "score")).alias("scored"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_count"),
    )
    ranked = F.sort_array(F.collect_list(
        F.struct((-F.col("count")).alias("order"), "source", "count")))
    return per_source.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum("enriched"), F.lit(0)).alias("enriched"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
        F.round(F.try_divide(F.sum("score_sum"), F.sum("score_count")), 1)
        .alias("average_score"),
        F.transform(
            F.slice(ranked, 1, 5),
            lambda r: F.struct(r["source"].alias("source"), r["count"].alias("count")),
        ).alias("top_sources"),
    )


# --- job status --------------------------------------------------------------

def job_class(item: Column) -> Column:
    """Class of a queued job: wrapped name, else the first argument's, else its own."""
    return F.coalesce(
        F.get_json_object(item, "$.wrapped"),
        F.get_json_object(item, "$.args[0].job_class"),
        F.get_json_object(item, "$.class"),
    )


def status_aggregates(at: Column) -> list[Column]:
    ours = F.col("job_class").startswith(JOB_PREFIX)
    queued = F.count_if(ours & (F.col("state") == "queued"))
    running = F.count_if(ours & (F.col("state") == "running"))
    return [
        ((queued + running) > 0).alias("active"),
        queued.alias("queued_count"),
        running.alias("running_count"),
        F.max(at).alias("updated_at"),
    ]


def job_status(job_runs: DataFrame, now: Column) -> DataFrame:
    """One row from (state, item); without jobs the idle row."""
    return job_runs.select("state", job_class(F.col("item")).alias("job_class")).agg(
        *status_aggregates(F.lit(None).cast("timestamp"))
    ).withColumn("updated_at", now)
