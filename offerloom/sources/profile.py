"""Scoring profile: one small JSON document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom.operators.quality import profile_problem
from offerloom.schemas import PROFILE


def parse_profiles(rows: DataFrame, raw: str = "profile") -> DataFrame:
    """Documents in a column -> ``parsed`` struct and ``problem`` (null if valid)."""
    return rows.withColumns({
        "problem": profile_problem(F.col(raw)),
        "parsed": F.from_json(F.col(raw), PROFILE),
    })


def load_profile(spark: SparkSession, path: str) -> dict:
    """Read and check the document; a broken rule is raised by its name."""
    documents = spark.read.text(path, wholetext=True)
    checked = documents.select("value", profile_problem(F.col("value")).alias("problem"))
    found = checked.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"Expected one scoring profile at {path}")
    if found[0]["problem"]:
        raise ValueError(found[0]["problem"])
    return json.loads(found[0]["value"])


def save_profile(spark: SparkSession, profile: dict, path: str) -> None:
    """Check a profile and overwrite the stored document with it."""
    row = spark.createDataFrame([(json.dumps(profile, ensure_ascii=False),)], "value string")
    problem = row.select(profile_problem(F.col("value"))).first()[0]
    if problem:
        raise ValueError(problem)
    row.coalesce(1).write.mode("overwrite").text(path)


def list_parameter(value: str | None, fallback: list | None, label: str) -> list[str]:
    """A comma list, or else a profile list: trimmed, without blanks or repeats."""
    items = value.split(",") if value and value.strip() else fallback
    if not isinstance(items, list):
        raise ValueError(f"Missing required scoring profile field: {label}")
    kept = list(dict.fromkeys(str(i).strip() for i in items if str(i).strip()))
    if not kept:
        raise ValueError(f"{label} must contain at least one value")
    return kept


def profile_lists(parsed: Column) -> dict[str, Column]:
    """Launch lists of a parsed profile: keywords and work modes."""

    def tidy(a: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(a, F.trim), lambda t: t != ""))

    return {
        "keywords": tidy(parsed["technology"]["primary"]),
        "work_modes": tidy(parsed["location"]["preference"]),
    }
