"""Discovery as table jobs: crawl plan in, crawled pages in, offers out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.fixed_values import (
    APEC_COMPANY_TYPES,
    APEC_MODE_CODES,
    FRANCE_TRAVAIL_HOST,
    LINKEDIN_MODE_CODES,
    LINKEDIN_RESULTS_PER_PAGE,
    LOCATION_MODES,
    PAGE_CAPS,
    SEARCH_BASES,
    WTTJ_MODE_CODES,
)
from offerloom.functions.arrays import iso, or_empty, put_step
from offerloom.functions.rules import by_source
from offerloom.functions.text import canonical_url, keyword as clean_keyword, strip, url_key
from offerloom.operators.incremental import step_version
from offerloom.registry import SourceSpec, active_sources

RUN = ["source", "keyword", "work_mode"]


# --- launch ------------------------------------------------------------------

def check_work_modes(modes: Iterable[str]) -> None:
    unsupported = [m for m in modes if m not in LOCATION_MODES]
    if unsupported:
        raise ValueError(
            f"Unsupported work mode(s): {', '.join(unsupported)}. "
            f"Supported values: {', '.join(LOCATION_MODES)}"
        )


def mode_violations(rows: DataFrame, mode: str = "work_mode") -> DataFrame:
    return rows.where(~F.coalesce(F.col(mode).isin(LOCATION_MODES), F.lit(False)))


def launch_plan(
    keywords: DataFrame, modes: list[str], sources: list[SourceSpec] | None = None
) -> DataFrame:
    """keyword rows -> one row per source, keyword and work mode.

    Sources that cannot filter by mode get the first mode only. The few sources
    and modes are literal arrays, so the fan-out is an explode and not a join.
    """
    check_work_modes(modes)
    specs = active_sources() if sources is None else sources
    pairs = [
        F.struct(F.lit(s.name).alias("source"), F.lit(m).alias("work_mode"))
        for s in specs
        for m in (modes if s.filters_by_mode else modes[:1])
    ]
    return keywords.select("*", F.explode(F.array(*pairs)).alias("_target")).select(
        "_target.source", "keyword", "_target.work_mode",
        *[c for c in keywords.columns if c != "keyword"],
    )


def _code(mode: Column, codes: dict[str, str]) -> Column:
    case = F
    for name, code in codes.items():
        case = case.when(mode == name, F.lit(code))
    return case


def _form(c: Column) -> Column:
    return F.url_encode(c)


def _query(c: Column) -> Column:
    """Like form encoding, but ~ stays and * does not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _with_params(base: str, *params: Column) -> Column:
    joined = F.concat_ws("&", *params)
    return F.when(joined == "", F.lit(base)).otherwise(F.concat(F.lit(f"{base}?"), joined))


def _pair(name: str, value: Column) -> Column:
    """name=value; null (left out of the query) when the value is null."""
    return F.concat(F.lit(f"{name}="), value)


def search_url(source: Column, keyword: Column, mode: Column, page: Column) -> Column:
    """Address of one result page. Apec has no on-site filter: null there."""
    trimmed = F.nullif(strip(keyword), F.lit(""))
    given = F.coalesce(keyword, F.lit(""))
    page_text = page.cast("string")
    after_first = F.when(page > 1, page_text)
    linkedin_mode = F.coalesce(_pair("f_WT", _code(mode, LINKEDIN_MODE_CODES)), F.lit("f_WT"))
    apec_modes = [
        F.when(mode == name, F.concat_ws("&", *[F.lit(f"typesTeletravail={c}") for c in codes]))
        for name, codes in APEC_MODE_CODES.items()
    ]
    apec = _with_params(
        SEARCH_BASES["apec"],
        *[F.lit(f"typesConvention={c}") for c in APEC_COMPANY_TYPES],
        _pair("motsCles", _form(trimmed)),
        _pair("page", F.greatest(page - 1, F.lit(0)).cast("string")),
        *apec_modes,
    )
    capitalised = F.concat(F.upper(F.substring(trimmed, 1, 1)), F.substring(trimmed, 2, 2**31 - 1))
    wttj_mode = _code(mode, WTTJ_MODE_CODES)
    return by_source(source, {
        "linkedin": _with_params(
            SEARCH_BASES["linkedin"],
            _pair("keywords", _form(given)),
            _pair("start", ((page - 1) * LINKEDIN_RESULTS_PER_PAGE).cast("string")),
            linkedin_mode,
        ),
        "hellowork": _with_params(
            SEARCH_BASES["hellowork"], _pair("k", _form(trimmed)), _pair("p", after_first)),
        "apec": F.when(
            F.coalesce(mode, F.lit("")).isin("", *APEC_MODE_CODES), apec),
        "cadremploi": _with_params(
            SEARCH_BASES["cadremploi"],
            _pair("motsCles", _form(trimmed)),
            _pair("motscles", _form(capitalised)),
            _pair("page", after_first),
        ),
        "france_travail": _with_params(
            SEARCH_BASES["france_travail"],
            _pair("motsCles", _query(given)),
            F.lit("offresPartenaires=true&rayon=10&tri=0"),
        ),
        "wttj": _with_params(
            SEARCH_BASES["wttj"],
            _pair("query", _query(keyword)),
            F.lit("refinementList%5Boffices.country_code%5D%5B%5D=FR"),
            _pair("refinementList%5Bremote%5D%5B%5D", wttj_mode),
            _pair("page", page_text),
        ),
    })


def with_search_urls(plan: DataFrame, pages: int | None = None) -> DataFrame:
    """Crawl plan with one row and address per result page.

    Without ``pages`` each source gets as many pages as it may be crawled for.
    """
    last = page_cap(F.col("source")) if pages is None else F.lit(pages)
    return plan.withColumn("page", F.explode(F.sequence(F.lit(1), last))).withColumn(
        "search_url",
        search_url(F.col("source"), F.col("keyword"), F.col("work_mode"), F.col("page")),
    )


def page_cap(source: Column) -> Column:
    return by_source(source, {name: F.lit(cap) for name, cap in PAGE_CAPS.items()})


# --- crawl results -----------------------------------------------------------

def crawled_pages(crawl: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Pages a crawl would have read: up to the first one without a next page,
    never beyond the source's cap.

    The cap is a row filter. The stop page of a run is a plain minimum (partial
    aggregation, no window), joined back null-safely on the run.
    """
    run = run or RUN
    capped = crawl.where(F.col("page") <= page_cap(F.col("source")))
    stops = (
        capped.where(~F.coalesce(F.col("has_next_page"), F.lit(False)))
        .groupBy(*[F.col(c).alias(f"_{c}") for c in run])
        .agg(F.min("page").alias("_stop"))
    )
    same_run = F.lit(True)
    for c in run:
        same_run &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        capped.join(stops, same_run, "left")
        .where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
        .select(*crawl.columns)
    )


def sightings(crawl: DataFrame) -> DataFrame:
    """One row per url on a crawled page, with its key and order of arrival."""
    rows = crawl.select(
        "source", "keyword", "page", "discovered_at",
        F.posexplode("discovered_urls").alias("position", "raw_url"),
    )
    url = canonical_url(F.col("source"), F.col("raw_url"), FRANCE_TRAVAIL_HOST)
    return rows.withColumn("url", url).select(
        url_key(F.col("url")).alias("url_hash"),
        "url",
        "source",
        clean_keyword(F.coalesce(F.col("keyword"), F.lit(""))).alias("keyword"),
        F.col("discovered_at").alias("seen_at"),
        F.struct("discovered_at", "page", "position", "source").alias("seq"),
    )


def distinct_urls(sighted: DataFrame) -> DataFrame:
    return sighted.select("url_hash", "url").dropDuplicates(["url_hash"])


def keyword_lists(sighted: DataFrame, key: str = "url_hash") -> DataFrame:
    """Keywords per url in order of first arrival, blanks left out.

    The first grouping (url, keyword) shrinks a url seen very often to its
    distinct keywords before anything is collected.
    """
    first = sighted.where(F.col("keyword") != "").groupBy(key, "keyword").agg(
        F.min("seq").alias("seq"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "keyword")))
    return first.groupBy(key).agg(
        F.transform(ordered, lambda x: x["keyword"]).alias("keywords"))


def seen_range(sighted: DataFrame, key: str = "url_hash") -> DataFrame:
    """First and last sighting per url."""
    return sighted.groupBy(key).agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


def digest(sighted: DataFrame) -> DataFrame:
    """Everything an upsert needs, one row per url.

    Two partial aggregations: per (url, keyword), which flattens a hot url, then
    per url over the few rows that are left.
    """
    per_keyword = sighted.groupBy("url_hash", "keyword").agg(
        F.min("seq").alias("seq"),
        F.max(F.struct("seq", "source", "url")).alias("latest"),
        F.min("seen_at").alias("first_at"),
        F.max("seen_at").alias("last_at"),
    )
    ordered = F.sort_array(F.collect_list(
        F.when(F.col("keyword") != "", F.struct("seq", "keyword"))))
    return per_keyword.groupBy("url_hash").agg(
        F.max("latest").alias("latest"),
        F.transform(ordered, lambda x: x["keyword"]).alias("keywords"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ).select("url_hash", "latest.url", "latest.source", "keywords", "first_at", "last_at")


def merge_digests(digests: DataFrame) -> DataFrame:
    """Combine digests of several batches (column ``batch`` gives their order).

    Per url and batch there is one row, so a url costs at most one row a batch.
    """
    per_keyword = digests.select(
        "url_hash", "batch", F.posexplode_outer("keywords").alias("place", "keyword"),
        "url", "source", "first_at", "last_at",
    ).groupBy("url_hash", "keyword").agg(
        F.min(F.struct("batch", "place")).alias("seq"),
        F.max(F.struct("last_at", "batch", "url", "source")).alias("latest"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    ordered = F.sort_array(F.collect_list(
        F.when(F.col("keyword").isNotNull(), F.struct("seq", "keyword"))))
    return per_keyword.groupBy("url_hash").agg(
        F.max("latest").alias("latest"),
        F.transform(ordered, lambda x: x["keyword"]).alias("keywords"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    ).select("url_hash", "latest.url", "latest.source", "keywords", "first_at", "last_at")


def claims(offers: DataFrame, incoming: DataFrame) -> DataFrame:
    """A digest by the offer that each row belongs to: the one with its key, else the one with its url
    under another key (the least such key), else a new one.

    Both ways are equi-joins on narrow columns; only rows whose key is not there look for their url. An
    offer claimed both ways gets both rows as one: url and source come from the row with its key alone.
    """
    columns = ["url_hash", "source", "url", "keywords", "first_at", "last_at"]
    rows = incoming.select(*columns)
    there = offers.select("url_hash").distinct()
    owners = offers.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("url_hash").alias("_owner"))
    by_key = rows.join(there, "url_hash", "left_semi").select(*columns, F.lit(False).alias("_by_url"))
    other = rows.join(there, "url_hash", "left_anti").join(owners, "url", "left")
    by_url = other.select(
        F.coalesce("_owner", "url_hash").alias("url_hash"), *columns[1:], F.col("_owner").isNotNull().alias("_by_url"))
    parts = F.sort_array(F.collect_list(F.struct("_by_url", "first_at", "last_at", "keywords")))
    own = F.struct((~F.col("_by_url")).alias("own"), "last_at", "url", "source")
    merged = by_key.unionByName(by_url).groupBy("url_hash").agg(
        F.max(own).alias("_from"), parts.alias("_parts"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return merged.select(
        "url_hash", F.when(F.col("_from.own"), F.col("_from.url")).alias("url"),
        F.when(F.col("_from.own"), F.col("_from.source")).alias("source"),
        F.flatten(F.transform("_parts", lambda p: p["keywords"])).alias("keywords"), "first_at", "last_at")


def upsert(offers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge a digest into the offers table: one full outer join on the url key.

    New urls become rows; known ones take source, url and new keywords, keep
    their discovery step and move ``last_seen_at`` forward. A row whose key is
    unknown, but whose url is stored under another key, goes to that offer, which
    keeps its source. Applying a digest twice changes nothing, unless it moves a url away.
    """
    new = claims(offers, incoming).select(
        "url_hash", F.lit(True).alias("_seen"),
        *[F.col(c).alias(f"_{c}") for c in ("url", "source", "keywords", "first_at", "last_at")],
    )
    both = offers.join(new, "url_hash", "full_outer")
    seen = F.col("_seen").isNotNull()
    steps = F.col("steps_details")
    found = put_step(
        steps, "discovery", iso(F.col("_first_at")), step_version(F.coalesce(F.col("_source"), F.col("source")), "discovery"))
    changed = {
        "id": F.coalesce(F.col("id"), F.xxhash64("url_hash")),
        "source": F.coalesce(F.col("_source"), F.col("source")),
        "url": F.coalesce(F.col("_url"), F.col("url")),
        "keywords": F.array_distinct(
            F.concat(or_empty(F.col("keywords")), or_empty(F.col("_keywords")))),
        "steps_details": F.when(
            seen & ~F.coalesce(F.map_contains_key(steps, "discovery"), F.lit(False)), found
        ).otherwise(steps),
        "last_seen_at": F.greatest(F.col("last_seen_at"), F.col("_last_at")),
        "rejected": F.coalesce(F.col("rejected"), F.lit(False)),
        "primary_technologies": or_empty(F.col("primary_technologies")),
        "secondary_technologies": or_empty(F.col("secondary_technologies")),
        "created_at": F.coalesce(F.col("created_at"), F.col("_first_at")),
        "updated_at": F.greatest(F.col("updated_at"), F.col("_last_at")),
    }
    return both.withColumns({k: v for k, v in changed.items() if k in offers.columns}).select(
        *offers.columns)
