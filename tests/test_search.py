import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import search
from offerloom.operators.search import SearchParams, params_from_request, toggle_sort

NOW = dt.datetime(2026, 4, 10, 15, 30)


def test_unknown_parameters_fall_back():
    p = SearchParams(sort_by="price", sort_direction="sideways", location_modes=["ON_SITE"])
    assert (p.sort_by, p.sort_direction, p.location_modes) == ("first_seen_at", "desc", ["on-site"])
    assert SearchParams(sort_direction="ASC").sort_direction == "asc"


@pytest.mark.parametrize("bad", [{"per_page": 0}, {"page": 0}])
def test_impossible_pages_are_refused(bad):
    with pytest.raises(ValueError):
        SearchParams(**bad)


def test_request_parameters():
    p = params_from_request(
        {"source": "apec,,linkedin", "locationModes": "REMOTE,x", "page": "3",
         "seenField": "last_seen_at", "datePreset": "yesterday"}, NOW)
    assert p.sources == ["apec", "linkedin"] and p.location_modes == ["remote"]
    assert (p.page, p.sort_by, p.sort_direction) == (3, "score", "desc")
    assert p.first_seen_after is None
    assert p.last_seen_after == dt.datetime(2026, 4, 9)
    assert p.last_seen_before == dt.datetime(2026, 4, 9, 23, 59, 59, 999000)
    d = params_from_request({"page": "-2", "datePreset": "never", "sortBy": "x"}, NOW)
    assert (d.page, d.first_seen_after, d.first_seen_before) == (
        1, dt.datetime(2026, 4, 10), NOW)


def test_sort_toggle():
    assert toggle_sort("score", "desc", "score") == ("score", "asc")
    assert toggle_sort("score", "asc", "score") == ("score", "desc")
    assert toggle_sort("score", "asc", "title") == ("title", "desc")


@pytest.fixture(scope="module")
def offers(spark):
    rng = random.Random(7)
    # a third of the rows share one score, and some have none
    rows = [
        (i, rng.choice([50, 50, None, rng.randint(0, 100)]), f"c{rng.randint(0, 9)}", i % 7 == 0)
        for i in range(3000)
    ]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, score int, company string, rejected boolean").withColumn(
        "first_seen_at", F.lit(NOW))


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("offset", [0, 990, 1777, 2560, 5000])
def test_deep_page_equals_sorted_list(offers, direction, offset):
    rows, df = offers
    sign = 1 if direction == "asc" else -1
    ordered = sorted(
        (r for r in rows if not r[3]),
        key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
    params = SearchParams(per_page=25, sort_by="score", sort_direction=direction)
    for top_rows in (30, 400, 10_000):  # the answer does not depend on how far the range is narrowed
        page = search.page_at(search.visible(df), params, offset, top_rows).select("id").collect()
        assert [r[0] for r in page] == [r[0] for r in ordered[offset:offset + 25]]


def test_page_and_totals(offers):
    rows, df = offers
    params = SearchParams(page=2, per_page=10, sort_by="company", sort_direction="asc")
    page = [r["id"] for r in search.search_page(df, params).collect()]
    ordered = sorted((r for r in rows if not r[3]), key=lambda r: (r[2], r[0]))
    assert page == [r[0] for r in ordered[10:20]]
    totals = search.search_totals(df, params).first()
    assert (totals["total_count"], totals["total_pages"]) == (len(ordered), -(-len(ordered) // 10))
