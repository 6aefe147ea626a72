"""Page quality and result pages, on the parsed ``doc`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.fixed_values import (
    APEC_MIN_DETAIL_BLOCKS,
    APEC_REFERENCE,
    APEC_RESULTS_PER_PAGE,
    BOT_WALL_PAGE,
    CADREMPLOI_WALL_BODY,
    CADREMPLOI_WALL_TITLE,
    FRANCE_TRAVAIL_HOST,
    HELLOWORK_FULL_PAGE,
    LINK_PATTERNS,
    LOGIN_PAGE,
    MIN_BODY_TEXT,
    NO_RESULTS_PAGE,
    NOT_AN_OFFER,
    OFFER_URL_SHAPES,
    PAGE_CAPS,
    SHELL_PAGES,
)
from offerloom.functions import nodes as N
from offerloom.functions.rules import by_source
from offerloom.functions.text import canonical_url, strip
from offerloom.sources.markup import with_doc


def html_state(html: Column) -> Column:
    """empty, shell (a document without content) or full."""
    compact = F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), r"\s+", "")
    return (
        F.when(compact == "", "empty").when(compact.isin(SHELL_PAGES), "shell").otherwise("full")
    )


def content_markers(doc: Column) -> dict[str, Column]:
    """Does the page have the elements that a loaded offer of the source shows?"""
    unified_title = N.select_inside(
        doc, N.css_class("job-details-jobs-unified-top-card__job-title"), N.tag("h1"))
    return {
        "linkedin": (F.size(unified_title) > 0) | N.any_of(
            doc,
            N.css_class("jobs-unified-top-card__job-title"),
            N.css_class("jobs-description__content"),
            N.css_class("show-more-less-html__markup"),
            N.attr("data-testid", "expandable-text-box"),
        ),
        "hellowork": N.any_of(doc, N.tag("h1", "h2"), N.both(
            N.tag("a"), N.attr_has("href", "/fr-fr/entreprises/"))),
        "apec": N.any_of(doc, N.tag("h1", "apec-offre-metadata"), N.css_class("details-post")),
        "cadremploi": N.any_of(doc, N.tag("h1"), N.attr_has("class", "job-title"),
                           N.attr_has("class", "offer-title")),
        "france_travail": N.any_of(doc, N.attr("itemprop", "description")),
        "wttj": N.any_of(doc, N.tag("h1", "h2", "section"), N.has_attr("data-testid"),
                     N.attr_has("class", "job"), N.attr_has("class", "description")),
    }


def page_status(source: Column, state: Column, doc: Column, url: Column) -> Column:
    """"ok" or the first check that fails."""
    title = F.coalesce(strip(N.first_text(doc, N.select(doc, N.tag("title")))), F.lit(""))
    body_length = F.length(doc["visible"])
    markers = content_markers(doc)
    metadata = F.coalesce(
        N.first_text(doc, N.select(doc, N.tag("apec-offre-metadata"))), F.lit(""))
    title_and_url = F.concat_ws(" ", title, url)
    with_metadata = F.concat_ws(" ", title, url, metadata)
    details = F.size(N.select(doc, N.css_class("details-post")))

    def missing(name: str) -> Column:
        return F.when(~markers[name], "missing_main_content")

    checks = {
        "linkedin": F.when(title_and_url.rlike(LOGIN_PAGE), "challenge_or_login").when(
            ~markers["linkedin"] & (body_length < MIN_BODY_TEXT["linkedin"]),
            "missing_job_markers"),
        "hellowork": missing("hellowork")
        .when(title_and_url.rlike(BOT_WALL_PAGE), "challenge_or_login")
        .when(title_and_url.rlike(NOT_AN_OFFER["hellowork"]), "not_an_offer")
        .when(~url.rlike(OFFER_URL_SHAPES["hellowork"]), "unexpected_url")
        .when(body_length < MIN_BODY_TEXT["hellowork"], "small_body"),
        "apec": missing("apec")
        .when(with_metadata.rlike(BOT_WALL_PAGE), "challenge_or_login")
        .when(with_metadata.rlike(NOT_AN_OFFER["apec"]), "not_an_offer")
        .when(~url.rlike(OFFER_URL_SHAPES["apec"]), "unexpected_url")
        .when(~metadata.rlike(APEC_REFERENCE), "missing_metadata")
        .when(details < APEC_MIN_DETAIL_BLOCKS, "few_details")
        .when(body_length < MIN_BODY_TEXT["apec"], "small_body"),
        "cadremploi": missing("cadremploi"),
        "france_travail": missing("france_travail"),
        "wttj": missing("wttj"),
    }
    return (
        F.when(state == "empty", "empty_html")
        .when(state == "shell", "shell_html")
        .when(~source.isin(list(checks)), "unknown_source")
        .otherwise(F.coalesce(by_source(source, checks), F.lit("ok")))
    )


def classify(pages: DataFrame, html: str = "html", keep_doc: bool = False) -> DataFrame:
    """Add ``page_status`` (needs source, url and the HTML column)."""
    docs = with_doc(pages.withColumn("_state", html_state(F.col(html))), html)
    judged = docs.withColumn(
        "page_status",
        page_status(F.col("source"), F.col("_state"), F.col("doc"), F.col("url")),
    ).drop("_state")
    return judged if keep_doc else judged.drop("doc")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("page_status") == "ok")


def rejects(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("page_status") != "ok")


def require_ok(judged: DataFrame) -> DataFrame:
    """Strict form: the first bad page stops the job with its status."""
    message = F.concat(F.lit("page rejected: "), F.col("page_status"), F.lit(" "), F.col("url"))
    checked = F.when(
        F.col("page_status") == "ok", F.col("page_status")).otherwise(F.raise_error(message))
    return judged.withColumn("page_status", checked)


# --- result pages ------------------------------------------------------------

def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0)


def absolute(href: Column, site: Column) -> Column:
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(
        href.startswith("/"), F.concat(site, href)).otherwise(href)


def result_links(source: Column, doc: Column, url: Column) -> Column:
    """Offer addresses on a result page: cleaned, distinct, in page order."""
    site = origin(url)
    anchors = N.select(doc, N.both(N.tag("a"), N.has_attr("href")))

    def hrefs(nodes: Column) -> Column:
        return F.transform(nodes, lambda n: n["attrs"]["href"])

    def by_pattern(name: str) -> Column:
        pattern = LINK_PATTERNS[name]
        return F.filter(hrefs(anchors), lambda h: h.rlike(pattern))

    cards = N.select(doc, N.both(
        N.tag("li"), N.css_class("scaffold-layout__list-item"),
        N.has_attr("data-occludable-job-id")))

    def card_link(card: Column) -> Column:
        own = N.within(doc, card, N.both(
            N.tag("a"), N.attr_has("href", "/jobs/view/")))
        card_id = F.nullif(card["attrs"]["data-occludable-job-id"], F.lit(""))
        return F.coalesce(
            N.first(own)["attrs"]["href"],
            F.concat(site, F.lit("/jobs/view/"), card_id, F.lit("/")),
        )

    results = N.inside_any(
        N.select_inside(
            doc, N.both(N.tag("li"), N.css_class("result")),
            N.both(N.tag("a"), N.css_class("media"),
                   N.attr_matches("href", LINK_PATTERNS["france_travail"])),
        ),
        N.select(doc, N.both(N.tag("ul"), N.css_class("result-list"))),
    )
    raw = by_source(source, {
        "linkedin": F.array_compact(F.transform(cards, card_link)),
        "france_travail": hrefs(results),
        **{name: by_pattern(name) for name in ("cadremploi", "hellowork", "apec", "wttj")},
    })
    return F.array_distinct(F.transform(raw, lambda h: canonical_url(
        source,
        F.when(source == "france_travail", h).otherwise(absolute(h, site)),
        FRANCE_TRAVAIL_HOST,
    )))


def read_result_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Result pages (source, url, page, html, ...) -> crawl results.

    ``page_status`` is ok, stop (a later page without links), no_results, or the
    error that would end the crawl.
    """
    doc, source, page, url = F.col("doc"), F.col("source"), F.col("page"), F.col("url")
    with N.looked_up() as index:
        found = _result_columns(doc, source, page, url)
    docs = with_doc(pages.withColumn("_state", html_state(F.col(html))), html, index=frozenset(index))
    read = docs
    for columns in found:
        read = read.withColumns(columns)
    return read.drop("doc", "_state")


def _result_columns(doc: Column, source: Column, page: Column, url: Column) -> list[dict[str, Column]]:
    title = F.coalesce(N.first_text(doc, N.select(doc, N.tag("title"))), F.lit(""))
    title_and_text = F.concat_ws(" ", title, doc["visible"])
    urls = F.col("discovered_urls")
    none = F.size(urls) == 0
    error, stop = F.lit("no_links"), F.lit("stop")
    bot_wall = F.when(title_and_text.rlike(BOT_WALL_PAGE), "challenge_or_login")
    status = by_source(source, {
        "linkedin": F.when(F.col("_state") == "shell", "shell_html")
        .when(F.concat_ws(" ", url, title).rlike(LOGIN_PAGE), "challenge_or_login")
        .when(none, error),
        "cadremploi": F.when(
            title.rlike(CADREMPLOI_WALL_TITLE) | F.array_join(doc["pieces"], "").rlike(CADREMPLOI_WALL_BODY),
            "challenge_or_login"),
        "hellowork": bot_wall.when(none & (page <= 1), error).when(none, stop),
        "apec": bot_wall.when(none & doc["visible"].rlike(NO_RESULTS_PAGE), "no_results")
        .when(none & (page <= 1), error).when(none, stop),
        "france_travail": F.when(
            ~N.any_of(doc, N.both(N.tag("ul"), N.css_class("result-list"))), error),
        "wttj": F.when(none, error),
    })
    labelled = N.attr_matches("aria-label", "Next|Suivant")
    pager = N.css_class("jobs-search-pagination__button--next")
    next_buttons = N.select(doc, N.both(N.tag("button"), N.either(labelled, pager)))
    count = F.size(urls)
    has_next = by_source(source, {
        "linkedin": F.coalesce(
            N.on_first(next_buttons, lambda n: n["attrs"]["disabled"].isNull()), F.lit(False))
        & (page < PAGE_CAPS["linkedin"]),
        "hellowork": (count >= HELLOWORK_FULL_PAGE) & (page < PAGE_CAPS["hellowork"]),
        "apec": (count >= APEC_RESULTS_PER_PAGE) & (page < PAGE_CAPS["apec"]),
        "cadremploi": ~none & (page < PAGE_CAPS["cadremploi"]),
        "france_travail": F.lit(False),
        "wttj": N.any_of(doc, N.both(N.tag("button"), N.attr("data-testid", "pagination-next")))
        & (page < PAGE_CAPS["wttj"]),
    })
    return [
        {"discovered_urls": result_links(source, doc, url)},
        {"page_status": F.coalesce(status, F.lit("ok"))},
        {"has_next_page": (F.col("page_status") == "ok") & has_next},
    ]
