import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators import discovery
from offerloom.operators.latest import latest_per_key
from offerloom.plans.catalog import CATALOG
from offerloom.registry import active_sources

T0 = dt.datetime(2026, 1, 1)


def crawl(spark, rows):
    return spark.createDataFrame(rows, schemas.CRAWL_RESULTS)


def random_crawl(seed, n=300):
    rng = random.Random(seed)
    return [
        ("linkedin", rng.choice(["C# dev", "ruby", " ", "Data  Eng."]), "remote", 1,
         # one url is on every third page
         [f"https://x/{rng.choice([0, rng.randint(1, 20)])}?a=b" for _ in range(3)],
         True, T0 + dt.timedelta(seconds=rng.randint(0, 10_000)))
        for _ in range(n)
    ]


def expected_keywords(rows):
    lists = {}
    flat = [
        (r[6], r[3], pos, r[1], u.split("?")[0]) for r in rows for pos, u in enumerate(r[4])]
    for at, page, pos, kw, url in sorted(flat, key=lambda f: f[:3]):
        clean = " ".join("".join(c if c.isascii() and c.isalpha() else " " for c in kw).lower().split())
        seen = lists.setdefault(url, [])
        if clean and clean not in seen:
            seen.append(clean)
    return lists


def empty_offers(spark):
    return spark.createDataFrame([], schemas.OFFERS)


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_upsert_is_idempotent_and_keeps_order(spark):
    rows = random_crawl(3)
    incoming = discovery.digest(discovery.sightings(crawl(spark, rows)))
    once = discovery.upsert(empty_offers(spark), incoming)
    twice = discovery.upsert(once, incoming)
    assert as_rows(once) == as_rows(twice)
    found = {r["url"]: r for r in once.collect()}
    wanted = expected_keywords(rows)
    # simultaneous sightings may come in either order
    assert {u: sorted(r["keywords"]) for u, r in found.items()} == {
        u: sorted(k) for u, k in wanted.items()}
    assert all(r["steps_details"]["discovery"]["version"] == 1 for r in found.values())


def test_input_order_does_not_matter(spark):
    rows = random_crawl(5)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    one, two = (
        discovery.upsert(
            empty_offers(spark), discovery.digest(discovery.sightings(crawl(spark, r))))
        for r in (rows, shuffled))
    assert as_rows(one) == as_rows(two)


def test_known_offer_keeps_first_sighting(spark):
    old = discovery.digest(discovery.sightings(crawl(spark, [
        ("apec", "ruby", "remote", 1, ["https://x/1"], True, T0)])))
    new = discovery.digest(discovery.sightings(crawl(spark, [
        ("hellowork", "Go", "remote", 1, ["https://x/1"], True, T0 + dt.timedelta(days=2))])))
    row = discovery.upsert(discovery.upsert(empty_offers(spark), old), new).first()
    assert row["source"] == "hellowork" and row["keywords"] == ["ruby", "go"]
    assert row["steps_details"]["discovery"]["at"] == "2026-01-01T00:00:00Z"
    assert row["last_seen_at"] == T0 + dt.timedelta(days=2)


def test_paging_stops(spark):
    rows = []
    for page in range(1, 31):
        rows.append(("apec", "a", "remote", page, [], True, T0))          # cap 25
        rows.append(("linkedin", "a", "remote", page, [], page != 4, T0))  # stops at 4
        rows.append(("france_travail", "a", None, page, [], False, T0))    # single pass
        rows.append(("wttj", "a", None, page, [], None, T0))               # unknown means stop
    kept = discovery.crawled_pages(crawl(spark, rows)).groupBy("source").count().collect()
    assert dict(map(tuple, kept)) == {"apec": 25, "linkedin": 4, "france_travail": 1, "wttj": 1}


def test_launch_rejects_unknown_modes(spark):
    keywords = spark.createDataFrame([("ruby",), ("nodejs",)], "keyword string")
    with pytest.raises(ValueError, match="Unsupported work mode.*office"):
        discovery.launch_plan(keywords, ["remote", "office"])
    plan = discovery.launch_plan(keywords, ["remote", "hybrid"])
    assert plan.count() == 2 * (3 * 2 + 2)
    assert plan.where("source = 'hellowork'").select("work_mode").distinct().collect()[0][0] == "remote"


def test_search_addresses(spark):
    plan = spark.createDataFrame([
        ("linkedin", "c++ é", "hybrid"), ("apec", "ruby", "on-site"), ("wttj", "a*b~", "hybrid"),
    ], "source string, keyword string, work_mode string")
    urls = {(r["source"], r["page"]): r["search_url"]
            for r in discovery.with_search_urls(plan, pages=2).collect()}
    assert urls["linkedin", 2] == (
        "https://www.linkedin.com/jobs/search/?keywords=c%2B%2B+%C3%A9&start=25&f_WT=3")
    assert urls["apec", 1] is None
    assert urls["wttj", 1] == (
        "https://www.welcometothejungle.com/fr/jobs?query=a%2Ab~"
        "&refinementList%5Boffices.country_code%5D%5B%5D=FR"
        "&refinementList%5Bremote%5D%5B%5D=partial&page=1")
    assert discovery.with_search_urls(plan.where("source = 'linkedin'")).count() == 10


def test_latest_row_of_a_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500)] + [("cold", 3, "x")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, v string")
    assert sorted(map(tuple, latest_per_key(df, "k", ["n"]).collect())) == [
        ("cold", 3, "x"), ("hot", 499, "v499")]


def test_registered_crawl_plan_has_every_page_of_a_source(spark, small_tables):
    rows = CATALOG["search_urls"].run(spark, small_tables).groupBy("source").agg(F.min("page"), F.max("page")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == {
        s.name: (1, s.page_cap) for s in active_sources()}
