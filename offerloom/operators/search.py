"""Offer search: filters, whitelisted sort, pages and totals."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.fixed_values import DETAIL_COLUMNS, LIST_COLUMNS, SORT_KEYS, STEPS
from offerloom.functions.arrays import or_empty, overlaps, step_time, union_distinct
from offerloom.functions.dates import preset_range
from offerloom.functions.text import search_label

TOP_ROWS = 10_000  # rows that one top-k may rank in memory
SAMPLED_KEYS = 4096  # keys that one narrowing step looks at
RANGES = 64  # ranges that one narrowing step counts


@dataclass
class SearchParams:
    page: int = 1
    per_page: int = 25
    sources: list[str] = field(default_factory=list)
    location_modes: list[str] = field(default_factory=list)
    first_seen_after: dt.datetime | None = None
    first_seen_before: dt.datetime | None = None
    last_seen_after: dt.datetime | None = None
    last_seen_before: dt.datetime | None = None
    sort_by: str = "first_seen_at"
    sort_direction: str = "desc"
    technologies: list[str] = field(default_factory=list)
    fold_case_first: bool = False

    def __post_init__(self):
        if self.per_page < 1:
            raise ValueError("per_page must be at least 1")
        if self.page < 1:
            raise ValueError("page must be at least 1")
        if self.sort_by not in SORT_KEYS:
            self.sort_by = "first_seen_at"
        self.sort_direction = "asc" if str(self.sort_direction).lower() == "asc" else "desc"
        self.location_modes = [m.lower().replace("_", "-") for m in self.location_modes]


def params_from_request(request: Mapping[str, str], now: dt.datetime) -> SearchParams:
    """Text parameters of a search page; unknown values fall back to defaults."""

    def items(name: str) -> list[str]:
        return [v for v in (request.get(name) or "").split(",") if v]

    def one_of(name: str, allowed: list[str], default: str) -> str:
        value = request.get(name)
        return value if value in allowed else default

    page = re.match(r"\s*\d+", request.get("page") or "")
    seen = one_of("seenField", ["first_seen_at", "last_seen_at"], "first_seen_at")
    after, before = preset_range(request.get("datePreset") or "today", now)
    prefix = seen.removesuffix("_at")
    return SearchParams(
        page=max(1, int(page.group())) if page else 1,
        sources=items("source"),
        location_modes=[
            m for m in items("locationModes") if m in ("REMOTE", "HYBRID", "ON_SITE")],
        technologies=items("technologies"),
        sort_by=one_of("sortBy", SORT_KEYS, "score"),
        sort_direction=one_of("sortDirection", ["asc", "desc"], "desc"),
        **{f"{prefix}_after": after, f"{prefix}_before": before},
    )


def toggle_sort(sort_by: str, direction: str, column: str) -> tuple[str, str]:
    """A second click flips the direction; another column starts descending."""
    if sort_by == column:
        return sort_by, "desc" if direction == "asc" else "asc"
    return column, "desc"


# --- projections -------------------------------------------------------------

def first_seen_at() -> Column:
    return step_time(F.col("steps_details"), "discovery")


def location_label(mode: Column) -> Column:
    return (
        F.when(mode == "remote", "Remote")
        .when(mode == "hybrid", "Hybrid")
        .when(mode == "on-site", "On-site")
        .otherwise("Unknown")
    )


def steps_struct(steps: Column) -> Column:
    """The five named steps as struct fields; a missing step is null."""
    return F.struct(*[steps[s].alias(s) for s in STEPS])


def _with_first_seen(offers: DataFrame) -> DataFrame:
    if "first_seen_at" in offers.columns:
        return offers
    return offers.withColumn("first_seen_at", first_seen_at())


def offer_list(offers: DataFrame) -> DataFrame:
    return _with_first_seen(offers).select(*LIST_COLUMNS)


def offer_detail(offers: DataFrame) -> DataFrame:
    return _with_first_seen(offers).select(*DETAIL_COLUMNS)


def technology_list(primary: Column, secondary: Column) -> Column:
    return union_distinct(or_empty(primary), or_empty(secondary))


# --- filters -----------------------------------------------------------------

def visible(offers: DataFrame) -> DataFrame:
    return offers.where(~F.col("rejected"))


def find_offer(offers: DataFrame, offer_id: int) -> DataFrame:
    return visible(offers).where(F.col("id") == offer_id).limit(1)


def uses_any_technology(technologies: list[str], fold_case_first: bool = False) -> Column:
    wanted = F.array(*[F.lit(re.sub("[^a-z]", "", t.lower())) for t in technologies])

    def hit(column: str) -> Column:
        labels = F.transform(
            or_empty(F.col(column)), lambda t: search_label(t, fold_case_first))
        return overlaps(labels, wanted)

    return hit("primary_technologies") | hit("secondary_technologies")


def matching(offers: DataFrame, params: SearchParams) -> DataFrame:
    """Visible offers that pass every filter given."""
    rows = visible(offers)
    if params.sources:
        rows = rows.where(F.col("source").isin(params.sources))
    if params.location_modes:
        rows = rows.where(F.col("location_mode").isin(params.location_modes))
    bounds = (
        ("last_seen_at", params.last_seen_after, params.last_seen_before),
        ("first_seen_at", params.first_seen_after, params.first_seen_before),
    )
    for column, after, before in bounds:
        if after is None and before is None:
            continue
        rows = _with_first_seen(rows)
        if after is not None:
            rows = rows.where(F.col(column) >= F.lit(after))
        if before is not None:
            rows = rows.where(F.col(column) <= F.lit(before))
    if params.technologies:
        rows = rows.where(uses_any_technology(params.technologies, params.fold_case_first))
    return rows


# --- order and pages ---------------------------------------------------------

def sort_order(params: SearchParams) -> list[Column]:
    """Nulls last in both directions; ties by id."""
    key = F.col(params.sort_by)
    ordered = key.asc_nulls_last() if params.sort_direction == "asc" else key.desc_nulls_last()
    return [ordered, F.col("id").asc()]


def search_page(offers: DataFrame, params: SearchParams) -> DataFrame:
    """One page of matches, in order."""
    rows = _with_first_seen(matching(offers, params))
    return page_at(rows, params, (params.page - 1) * params.per_page)


def _after(params: SearchParams, bound: tuple) -> Column:
    """Whether a row stands after (sort key, id) in the order of ``sort_order``."""
    value, row_id = bound
    key = F.col(params.sort_by)
    if value is None:
        return key.isNull() & (F.col("id") > row_id)
    beyond = key > F.lit(value) if params.sort_direction == "asc" else key < F.lit(value)
    return key.isNull() | beyond | ((key == F.lit(value)) & (F.col("id") > row_id))


def page_at(rows: DataFrame, params: SearchParams, offset: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """Exact page at any depth: a top-k inside the key range that holds it.

    While the page lies too deep in its range, a bounded sample of (key, id)
    cuts the range, one aggregation counts the rows after each cut, and the range
    shrinks to the cuts around the page. What reaches the driver is the sample
    and one row of counts. The id is part of the key, so equal sort keys are cut
    like any others.
    """
    order = sort_order(params)
    lower, upper = [], []  # predicates that bound the range
    while offset + params.per_page > top_rows:
        inside = rows
        for condition in lower + upper:
            inside = inside.where(condition)
        keys = inside.select(params.sort_by, "id")
        sample = keys.orderBy(F.xxhash64("id"), "id").limit(SAMPLED_KEYS)
        cuts = [tuple(r) for r in sample.orderBy(*order).collect()]
        cuts = cuts[:: max(1, len(cuts) // RANGES)]
        if not cuts:
            break
        counts = keys.agg(F.count("*"), *[F.count(F.when(_after(params, c), 1)) for c in cuts]).first()
        total, behind = counts[0], list(counts[1:])  # rows after each cut, falling
        before = [total - n for n in behind]
        first = max((i for i, n in enumerate(before) if n <= offset), default=None)
        last = min((i for i, n in enumerate(before) if n >= offset + params.per_page), default=None)
        if first is not None:
            lower = [_after(params, cuts[first])]
            offset -= before[first]
        if last is not None:
            upper = [~_after(params, cuts[last])]
        left = (total if last is None else before[last]) - (0 if first is None else before[first])
        if left == total:
            break
    for condition in lower + upper:
        rows = rows.where(condition)
    return rows.orderBy(*order).offset(offset).limit(params.per_page)


def search_totals(offers: DataFrame, params: SearchParams) -> DataFrame:
    return matching(offers, params).agg(
        F.count("*").alias("total_count"),
        F.ceil(F.count("*") / params.per_page).alias("total_pages"),
    )
