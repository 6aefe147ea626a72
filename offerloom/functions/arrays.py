"""Array set algebra and the step map."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom.schemas import STEPS_DETAILS


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def or_empty(a: Column) -> Column:
    return F.coalesce(a, empty_strings())


def difference(a: Column, b: Column) -> Column:
    """a minus b, keeping the duplicates of a (array_except would drop them)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union_distinct(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def array_from_json(c: Column) -> Column:
    return or_empty(F.from_json(c, "array<string>"))


def array_to_json(c: Column) -> Column:
    return F.to_json(c)


# --- steps_details -----------------------------------------------------------

def put_step(steps: Column, step: str, at: Column, version: Column) -> Column:
    """steps with one key set; a present key is replaced."""
    entry = F.create_map(
        F.lit(step),
        F.struct(at.cast("string").alias("at"), version.cast("int").alias("version")),
    )
    others = F.map_filter(
        F.coalesce(steps, F.create_map().cast(STEPS_DETAILS)),
        lambda k, _: k != step,
    )
    return F.map_concat(others, entry)


def steps_from_columns(columns: dict[str, Column], version: int = 1) -> Column:
    """Step map built from one timestamp-text column per step; null = absent."""
    entries = F.array(*[
        F.struct(
            F.lit(step).alias("key"),
            F.struct(at.alias("at"), F.lit(version).alias("version")).alias("value"),
        )
        for step, at in columns.items()
    ])
    present = F.filter(entries, lambda e: e["value"]["at"].isNotNull())
    return F.map_from_entries(present)


def step_time(steps: Column, step: str) -> Column:
    return F.try_to_timestamp(steps[step]["at"])


def iso(ts: Column) -> Column:
    """Timestamp as ISO-8601 text in UTC (the session zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
