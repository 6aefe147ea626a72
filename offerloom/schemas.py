"""Declared schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

STEP = T.StructType([
    T.StructField("at", T.StringType()),
    T.StructField("version", T.IntegerType()),
])
STEPS_DETAILS = T.MapType(T.StringType(), STEP)
STRINGS = T.ArrayType(T.StringType())

TECHNOLOGY_BREAKDOWN = T.StructType([
    T.StructField("warning", T.StringType()),
    T.StructField("missing_required_technologies", STRINGS),
    T.StructField("penalty_reason", T.StringType()),
    T.StructField("matching_secondary_technologies", STRINGS),
    T.StructField("bonus_reason", T.StringType()),
])
LOCATION_BREAKDOWN = T.StructType([
    T.StructField("mode", T.StringType()),
    T.StructField("preference", STRINGS),
    T.StructField("city", T.StringType()),
    T.StructField("allowed_cities", STRINGS),
    T.StructField("offer_remote_days", T.IntegerType()),
    T.StructField("required_remote_days", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("malus", T.IntegerType()),
    T.StructField("penalty_reason", T.StringType()),
])
SCORE_BREAKDOWN = T.StructType([
    T.StructField("technology", TECHNOLOGY_BREAKDOWN),
    T.StructField("location", LOCATION_BREAKDOWN),
])

OFFERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("url_hash", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("description_html", T.StringType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("location_mode", T.StringType()),
    T.StructField("offer_language", T.StringType()),
    T.StructField("normalized_seniority", T.StringType()),
    T.StructField("english_level_required", T.StringType()),
    T.StructField("hybrid_remote_days_min_per_week", T.IntegerType()),
    T.StructField("keywords", STRINGS, False),
    T.StructField("primary_technologies", STRINGS, False),
    T.StructField("secondary_technologies", STRINGS, False),
    T.StructField("salary_min_minor", T.LongType()),
    T.StructField("salary_max_minor", T.LongType()),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
    T.StructField("last_seen_at", T.TimestampType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    T.StructField("rejected", T.BooleanType(), False),
    T.StructField("score", T.IntegerType()),
    T.StructField("score_breakdown", SCORE_BREAKDOWN),
    T.StructField("steps_details", STEPS_DETAILS, False),
])

RAW_PAGES = T.StructType([
    T.StructField("url_hash", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("version", T.IntegerType()),
])

CRAWL_RESULTS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("discovered_urls", STRINGS),
    T.StructField("has_next_page", T.BooleanType()),
    T.StructField("discovered_at", T.TimestampType()),
])

MODEL_RESPONSES = T.StructType([
    T.StructField("url_hash", T.StringType(), False),
    T.StructField("payload", T.StringType()),
])

PROFILE = T.StructType([
    T.StructField("technology", T.StructType([
        T.StructField("primary", STRINGS),
        T.StructField("secondary", STRINGS),
    ])),
    T.StructField("location", T.StructType([
        T.StructField("preference", STRINGS),
        T.StructField("city", STRINGS),
        T.StructField("hybrid", T.StructType([
            T.StructField("city", STRINGS),
            T.StructField("remote_days_min_per_week", T.DoubleType()),
        ])),
        T.StructField("on_site", T.StructType([
            T.StructField("city", STRINGS),
        ])),
    ])),
])
