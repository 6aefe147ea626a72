"""Text normalisers: each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerloom.fixed_values import SYMBOL_ALIASES
from offerloom.functions.binding import keep_if

NBSP = " "
NARROW_NBSP = " "


def blank_to_null(c: Column) -> Column:
    return keep_if(c, lambda t: t != "")


def strip(c: Column) -> Column:
    """Trim every ASCII white-space character, not only spaces."""
    return F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", "")


def collapse(c: Column, extra_spaces: str = "", any_unicode_space: bool = False) -> Column:
    """Runs of white space become one space; ends are trimmed; blank becomes null."""
    if extra_spaces:
        c = F.translate(c, extra_spaces, " " * len(extra_spaces))
    run = r"(?U)\s+" if any_unicode_space else r"\s+"
    return blank_to_null(F.trim(F.regexp_replace(c, run, " ")))


def collapse_for(source: str, c: Column) -> Column:
    """White-space rule of one source (they differ in which spaces count)."""
    if source == "linkedin":
        return collapse(c, NBSP + NARROW_NBSP)
    if source == "hellowork":
        return collapse(c, NBSP)
    if source == "apec":
        return collapse(c, NBSP, any_unicode_space=True)
    return blank_to_null(strip(c))


def first_non_blank(*cs: Column) -> Column:
    return F.coalesce(*[blank_to_null(strip(c)) for c in cs])


# --- technologies ----------------------------------------------------------

def scoring_label(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")


def enriched_label(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, "[^a-zA-Z]", ""))


def search_label(t: Column, fold_case_first: bool = False) -> Column:
    """Stored label as search compares it.

    By default upper-case letters are dropped before lower-casing, so
    "PostgreSQL" becomes "ostgre"; ``fold_case_first`` lower-cases first.
    """
    if fold_case_first:
        return F.regexp_replace(F.lower(t), "[^a-z]", "")
    return F.lower(F.regexp_replace(t, "[^a-z]", ""))


def cased_labels(labels: Column) -> Column:
    """Trimmed, non-blank, distinct labels with their case kept."""
    trimmed = F.transform(labels, strip)
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


# --- keywords and relevance ------------------------------------------------

def keyword(c: Column) -> Column:
    letters = F.lower(F.regexp_replace(c, r"[^a-zA-Z\s]", " "))
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def relevance_text(c: Column) -> Column:
    for pattern, alias in SYMBOL_ALIASES:
        c = F.regexp_replace(c, pattern, f" {alias} ")
    letters = F.regexp_replace(F.lower(c), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def relevance_keywords(keywords: Column) -> Column:
    """Keywords plus the canonical name of every alias found in them."""

    def variants(k: Column) -> Column:
        aliases = [F.when(k.rlike(p), F.lit(alias)) for p, alias in SYMBOL_ALIASES]
        return F.array_compact(F.array(k, *aliases))

    texts = F.transform(
        F.flatten(F.transform(F.transform(keywords, strip), variants)), relevance_text)
    return F.array_distinct(F.filter(texts, lambda t: t != ""))


# --- urls ------------------------------------------------------------------

def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def canonical_url(source: Column, url: Column, france_travail_host: str) -> Column:
    no_query = F.regexp_replace(url, r"[?#].*$", "")
    no_fragment = F.regexp_replace(url, r"#.*$", "")
    return (
        F.when(source.isin("linkedin", "hellowork", "apec"), no_query)
        .when(source == "cadremploi", no_fragment)
        .when(
            (source == "france_travail") & url.startswith("/"),
            F.concat(F.lit(france_travail_host), url),
        )
        .otherwise(url)
    )


# --- lists -----------------------------------------------------------------

def parse_list(c: Column) -> Column:
    """"a, b,,a" -> [a, b]: comma list, trimmed, without blanks or repeats."""
    parts = F.transform(F.split(c, ","), strip)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


# --- markup already serialised ----------------------------------------------

def plain_text(markup: Column) -> Column:
    """Text of a serialised fragment: tags dropped, the entities that the
    serialiser writes decoded, white space collapsed; null becomes ''."""
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>", "")
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&nbsp;", NBSP), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
