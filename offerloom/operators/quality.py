"""Data-quality rules as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.fixed_values import (
    EMPLOYMENT_TYPES,
    ENGLISH_LEVELS,
    ISO_TIMESTAMP,
    LOCATION_MODES,
    OFFER_LANGUAGES,
    SENIORITY_LEVELS,
    STEPS,
)
from offerloom.functions.binding import bind

ENUM_COLUMNS = {
    "location_mode": LOCATION_MODES,
    "employment_type": EMPLOYMENT_TYPES,
    "offer_language": OFFER_LANGUAGES,
    "normalized_seniority": SENIORITY_LEVELS,
    "english_level_required": ENGLISH_LEVELS,
}
RANGES = {"hybrid_remote_days_min_per_week": (1, 5), "score": (0, 100)}
REQUIRED = ["source", "url", "url_hash", "last_seen_at"]


def _issue(field: str, message: str, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def offer_issues(columns: list[str]) -> list[Column]:
    issues = []
    for name in REQUIRED:
        if name in columns:
            value = F.col(name).cast("string")
            issues.append(_issue(
                name, "can't be blank", value.isNull() | value.rlike(r"^\s*$")))
    for name, (low, high) in RANGES.items():
        if name in columns:
            issues.append(_issue(
                name, f"must be between {low} and {high}", ~F.col(name).between(low, high)))
    if "city" in columns:
        issues.append(_issue("city", "is too long", F.length("city") > 255))
    for name, allowed in ENUM_COLUMNS.items():
        if name in columns:
            issues.append(_issue(name, "is not an allowed value", ~F.col(name).isin(allowed)))
    return issues


def offer_violations(offers: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, message): one pass over the table, no shuffle."""
    issues = F.array_compact(F.array(*offer_issues(offers.columns)))
    return offers.select(key, F.explode(issues).alias("_issue")).select(
        key, "_issue.field", "_issue.message")


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    return (
        rows.groupBy(column).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    )


# --- steps_details as raw JSON -------------------------------------------------

def steps_messages(raw: Column) -> Column:
    """Messages about a steps_details document (JSON text)."""
    steps = F.array(*[F.lit(s) for s in STEPS])
    payload_keys = F.array(F.lit("at"), F.lit("version"))

    def unsupported(keys: Column) -> Column:
        return F.transform(
            F.array_except(keys, steps), lambda k: F.concat(F.lit("contains unsupported step "), k))

    def about(step: str) -> Column:
        name = F.lit(f"step {step}")

        def inside(text: Column) -> Column:
            keys = F.coalesce(
                F.json_object_keys(text), F.array().cast("array<string>"))
            at, version = F.get_json_object(text, "$.at"), F.get_json_object(text, "$.version")
            extra = F.transform(
                F.array_except(keys, payload_keys),
                lambda k: F.concat(name, F.lit(" contains unsupported keys "), k))
            bad_at = F.when(
                F.array_contains(keys, "at") & ~F.coalesce(at.rlike(ISO_TIMESTAMP), F.lit(False)),
                F.concat(name, F.lit(" has an invalid at timestamp")))
            bad_version = F.when(
                F.array_contains(keys, "version")
                & ~F.coalesce(version.rlike(r"^0*[1-9]\d*$"), F.lit(False)),
                F.concat(name, F.lit(" has an invalid version")))
            return F.when(
                ~text.startswith("{"), F.array(F.concat(name, F.lit(" must be a hash")))
            ).otherwise(F.concat(extra, F.array_compact(F.array(bad_at, bad_version))))

        return F.coalesce(
            bind(F.get_json_object(raw, f"$.{step}"), inside), F.array().cast("array<string>"))

    messages = bind(
        F.json_object_keys(raw),
        lambda keys: F.concat(unsupported(keys), *[about(s) for s in STEPS]))
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>"))
        .when(~F.trim(raw).startswith("{"), F.array(F.lit("must be a hash")))
        .otherwise(messages)
    )


def steps_violations(rows: DataFrame, raw: str = "steps_details", key: str = "id") -> DataFrame:
    return rows.select(key, F.explode(steps_messages(F.col(raw))).alias("message"))


# --- profile documents -------------------------------------------------------

def profile_problem(raw: Column) -> Column:
    """First rule that a profile document (JSON text) breaks; null when it is valid."""
    data = F.try_parse_json(raw)

    def text(path: str) -> Column:
        return F.get_json_object(raw, path)

    def is_kind(path: str, opening: str) -> Column:
        return F.coalesce(text(path).startswith(opening), F.lit(False))

    def strings(path: str) -> Column:
        items = F.try_variant_get(data, path, "array<variant>")
        good = F.forall(items, lambda v: (F.schema_of_variant(v) == "STRING") & (
            F.trim(F.try_variant_get(v, "$", "string")) != ""))
        return F.coalesce(good, F.lit(False))

    preference = F.from_json(text("$.location.preference"), "array<string>")
    modes = F.array(*[F.lit(m) for m in LOCATION_MODES])
    good_preference = bind(preference, lambda p: (F.size(p) > 0) & (
        F.size(F.array_except(p, modes)) == 0) & (F.size(F.array_distinct(p)) == F.size(p)))
    hybrid, on_site = text("$.location.hybrid"), text("$.location.on_site")
    days = text("$.location.hybrid.remote_days_min_per_week")
    return (
        F.when(data.isNull(), "Invalid JSON in scoring profile")
        .when(~is_kind("$.technology.primary", "["), "Missing technology.primary")
        .when(~is_kind("$.technology.secondary", "["), "Missing technology.secondary")
        .when(~is_kind("$.location", "{"), "Missing location")
        .when(~is_kind("$.location.preference", "["), "Missing location.preference")
        .when(~F.coalesce(good_preference, F.lit(False)), "Invalid location.preference")
        .when(text("$.location.city").isNotNull() & ~strings("$.location.city"),
              "Invalid location.city")
        .when(hybrid.isNotNull() & ~is_kind("$.location.hybrid", "{"), "Invalid location.hybrid")
        .when(text("$.location.hybrid.city").isNotNull() & ~strings("$.location.hybrid.city"),
              "Invalid location.hybrid.city")
        .when(hybrid.isNotNull() & days.try_cast("double").isNull(),
              "Missing location.hybrid.remote_days_min_per_week")
        .when(on_site.isNotNull() & ~is_kind("$.location.on_site", "{"),
              "Invalid location.on_site")
        .when(text("$.location.on_site.city").isNotNull() & ~strings("$.location.on_site.city"),
              "Invalid location.on_site.city")
    )
