"""Ordered pattern rules as one CASE column: the first pattern that matches wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from offerloom.fixed_values import (
    CONTRACT_RULES,
    MODE_RULES,
    TELECOMMUTE,
    TOPCARD_MODE_CHIPS,
    TOPCARD_MODE_FRANCE,
    TOPCARD_MODE_LINE,
    TOPCARD_MODE_PAREN,
)
from offerloom.functions.binding import bind
from offerloom.functions.text import blank_to_null, collapse_for, strip


def first_match(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    def cases(t: Column) -> Column:
        case = F
        for pattern, value in rules:
            case = case.when(t.rlike(pattern), F.lit(value))
        return case

    return bind(text, cases)


def by_source(source: Column, columns: dict[str, Column]) -> Column:
    case = F
    for name, column in columns.items():
        case = case.when(source == name, column)
    return case


def contract_type(source: str, text: Column) -> Column:
    if source == "france_travail":
        # only the first line of the field; the next one is a sub-label
        text = strip(F.split(strip(text), "\n")[0])
    elif source in ("hellowork", "apec"):
        text = collapse_for(source, text)
    return first_match(text, CONTRACT_RULES[source])


def location_mode(source: str, texts: list[Column], job_location_type: Column | None = None) -> Column:
    """Work mode from texts in order of priority.

    Cadremploi trusts a TELECOMMUTE marker before any text, Hellowork after all
    of them. France Travail reads any text without a hint as on-site.
    """
    rules = MODE_RULES[source]
    remote = (
        F.when(job_location_type.rlike(TELECOMMUTE), F.lit("remote"))
        if job_location_type is not None
        else F.lit(None).cast("string")
    )
    if source == "france_travail":
        joined = F.array_compact(F.array(blank_to_null(strip(F.concat_ws(" ", *texts)))))
        return F.get(
            F.transform(joined, lambda t: F.coalesce(first_match(t, rules), F.lit("on-site"))),
            F.lit(0),
        )
    found = [first_match(t, rules) for t in texts]
    if source == "cadremploi":
        return F.coalesce(remote, *found)
    return F.coalesce(*found, remote)


def topcard_location_mode(page_text: Column) -> Column:
    """Optional LinkedIn work mode read from the metadata line of a page."""
    def word(t: Column) -> Column:
        return F.coalesce(*[
            blank_to_null(F.regexp_extract(t, pattern, 1))
            for pattern in (
                TOPCARD_MODE_PAREN, TOPCARD_MODE_CHIPS, TOPCARD_MODE_LINE, TOPCARD_MODE_FRANCE,
            )
        ])

    return first_match(bind(page_text, word), MODE_RULES["linkedin"])
