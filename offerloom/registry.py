"""Registered sources: one record per site, looked up by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from offerloom.fixed_values import LINK_PATTERNS, PAGE_CAPS, SEARCH_BASES, STEP_VERSIONS

ANALYZED_COLUMNS = [
    "title", "company", "location_mode", "city", "employment_type", "description_html",
    "salary_min_minor", "salary_max_minor", "salary_currency", "posted_at",
]
ENRICHED_COLUMNS = [
    "hybrid_remote_days_min_per_week", "primary_technologies", "secondary_technologies",
    "offer_language", "normalized_seniority", "english_level_required",
]


@dataclass(frozen=True)
class SourceSpec:
    name: str
    active: bool
    filters_by_mode: bool

    @property
    def page_cap(self) -> int:
        return PAGE_CAPS[self.name]

    @property
    def link_pattern(self) -> str:
        return LINK_PATTERNS[self.name]

    @property
    def search_base(self) -> str:
        return SEARCH_BASES[self.name]

    def version(self, step: str) -> int:
        return STEP_VERSIONS[self.name][("discovery", "fetch", "analyze", "enrich").index(step)]

    @property
    def analyzed_columns(self) -> list[str]:
        """Columns that analysis writes; LinkedIn gets mode and city later."""
        if self.name == "linkedin":
            return [c for c in ANALYZED_COLUMNS if c not in ("location_mode", "city")]
        return ANALYZED_COLUMNS

    @property
    def enriched_columns(self) -> list[str]:
        if self.name == "linkedin":
            return ["location_mode", "city"] + ENRICHED_COLUMNS
        return ENRICHED_COLUMNS


SOURCES: dict[str, SourceSpec] = {
    spec.name: spec
    for spec in (
        SourceSpec("linkedin", active=True, filters_by_mode=True),
        SourceSpec("france_travail", active=True, filters_by_mode=False),
        SourceSpec("cadremploi", active=True, filters_by_mode=True),
        SourceSpec("hellowork", active=True, filters_by_mode=False),
        SourceSpec("apec", active=True, filters_by_mode=True),
        SourceSpec("wttj", active=False, filters_by_mode=True),
    )
}


def source(name: str) -> SourceSpec:
    try:
        return SOURCES[name]
    except KeyError:
        raise KeyError(f"No source registered under {name!r}") from None


def active_sources() -> list[SourceSpec]:
    return [spec for spec in SOURCES.values() if spec.active]


def sources_table(spark: SparkSession) -> DataFrame:
    """The registry as a dimension table."""
    rows = [
        (s.name, s.active, s.filters_by_mode, s.page_cap, s.link_pattern, s.search_base)
        for s in SOURCES.values()
    ]
    return spark.createDataFrame(
        rows,
        "source string, active boolean, filters_by_mode boolean, page_cap int,"
        " link_pattern string, search_base string",
    )
