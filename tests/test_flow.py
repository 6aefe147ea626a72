"""The stage chain, its version gates, and the streaming forms of the jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators import discovery
from offerloom.operators.pages import accepted, classify, rejects, require_ok
from offerloom.operators.relevance import is_relevant, page_words, relevance_flag
from offerloom.plans.flow import analyze_offers, run_stages
from offerloom.sources import tables
from offerloom.streaming.chain import Chain, chain_events, start_chain
from offerloom.streaming.discovery import Discovery, crawl_stream, start_discovery
from offerloom.streaming.status import LiveStatus
from offerloom.streaming.throttle import throttled, throttled_stream

T0 = dt.datetime(2026, 3, 1)
NOW = dt.datetime(2026, 4, 1, 10)
PROFILE = {
    "technology": {"primary": ["ruby"], "secondary": ["sql"]},
    "location": {"preference": ["remote", "hybrid", "on-site"], "city": ["lyon"]},
}


def offer(i, source, keywords=(), steps=None, rejected=False, **more):
    row = {f.name: None for f in schemas.OFFERS.fields}
    url = f"https://x/{i}"
    row.update(
        id=i, source=source, url=url, url_hash=f"h{i}", keywords=list(keywords),
        primary_technologies=[], secondary_technologies=[], last_seen_at=T0, created_at=T0,
        updated_at=T0, rejected=rejected,
        steps_details={"discovery": ("2026-03-01T00:00:00Z", 1), **(steps or {})}, **more)
    return tuple(row[f.name] for f in schemas.OFFERS.fields)


def apec_page(i):
    return (f"<html><body><h1>Poste {i}</h1><apec-offre-metadata><ul class='details-offer-list'><li>Acme</li>"
            "<li><span>CDI</span></li><li>Lyon - 69</li></ul></apec-offre-metadata>"
            "<div class='details-post'><h4>Télétravail</h4><span>Total possible</span></div>"
            "\n<p>Ruby developer</p></body></html>")


@pytest.fixture(scope="module")
def inputs(spark):
    offers = spark.createDataFrame([
        offer(1, "apec", ["ruby"]),                                   # runs
        offer(2, "apec", ["cobol"]),                                  # rejected by its keywords
        offer(3, "apec", [], {"analyze": ("2026-03-02T00:00:00Z", 1)}, title="kept"),  # up to date
        offer(4, "apec", ["cobol"], {"analyze": ("2026-03-02T00:00:00Z", 1)}),  # up to date, rejected
        offer(5, "apec", ["ruby"]),                                   # no page
        offer(6, "linkedin", ["ruby"], location_mode="remote"),       # keeps mode until enriched
        offer(7, "apec", ["ruby"], rejected=True),                    # already rejected
        offer(8, "apec", [], {"analyze": ("2026-03-02T00:00:00Z", 9)}),  # newer version runs too
    ], schemas.OFFERS)
    pages = spark.createDataFrame([
        (f"h{i}", f"https://x/{i}", "apec" if i != 6 else "linkedin", apec_page(i), T0, 1)
        for i in (1, 2, 3, 4, 6, 7, 8)], schemas.RAW_PAGES)
    payload = {
        "location_mode": "hybrid", "city": "Lyon", "hybrid_remote_days_min_per_week": 4,
        "primary_technologies": ["Ruby"], "secondary_technologies": ["SQL"], "offer_language": "fr",
        "normalized_seniority": "senior", "english_level_required": "none"}
    responses = spark.createDataFrame(
        [(f"h{i}", json.dumps(payload)) for i in (1, 2, 3, 6)], schemas.MODEL_RESPONSES)
    return offers, pages, responses


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_analyze_gate_and_rejection(inputs):
    offers, pages, _ = inputs
    found = by_id(analyze_offers(offers, pages, F.lit(NOW)))
    assert len(found) == 8
    assert found[1]["title"] == "Poste 1" and found[1]["location_mode"] == "remote"
    assert found[1]["steps_details"]["analyze"] == ("2026-04-01T10:00:00Z", 1)
    assert found[2]["rejected"] and found[2]["title"] is None
    assert "analyze" not in found[2]["steps_details"]
    assert found[3]["title"] == "kept"
    assert found[4]["rejected"] and not found[5]["rejected"]
    assert found[5]["title"] is None
    assert found[6]["title"] == "Poste 6" and found[6]["location_mode"] == "remote"
    assert found[7]["title"] is None
    assert found[8]["steps_details"]["analyze"]["version"] == 1


def test_force_runs_everything_readable(inputs):
    offers, pages, _ = inputs
    found = by_id(analyze_offers(offers, pages, F.lit(NOW), force=True))
    assert found[3]["title"] == "Poste 3"
    assert found[7]["title"] is None and found[4]["title"] is None


def test_whole_chain(inputs):
    offers, pages, responses = inputs
    done = run_stages(offers, pages, responses, PROFILE, F.lit(NOW))
    found = by_id(done)
    one = found[1]
    assert set(one["steps_details"]) == {"discovery", "fetch", "analyze", "enrich", "score"}
    assert one["primary_technologies"] == ["ruby"] and one["secondary_technologies"] == ["sql"]
    assert one["hybrid_remote_days_min_per_week"] is None  # remote, so no hybrid days
    assert one["score"] == 100
    six = found[6]
    assert (six["location_mode"], six["city"]) == ("hybrid", "Lyon")
    assert six["primary_technologies"] == ["Ruby"]
    assert six["hybrid_remote_days_min_per_week"] == 4 and six["score"] == 73
    for skipped in (2, 4, 5, 7, 8):  # rejected, without a page or without a response
        assert found[skipped]["score"] is None and "score" not in found[skipped]["steps_details"]


def test_a_late_response_is_scored_when_it_comes(spark, inputs):
    offers, pages, responses = inputs
    first = run_stages(offers, pages, responses.limit(0), PROFILE, F.lit(NOW)).drop("topcard_text")
    assert all(r["score"] is None and "score" not in r["steps_details"] for r in first.collect())
    second = by_id(run_stages(first, pages, responses, PROFILE, F.lit(NOW + dt.timedelta(days=1))))
    assert second[1]["score"] == 100 and second[6]["score"] == 73
    assert second[1]["steps_details"]["score"]["at"] == "2026-04-02T10:00:00Z"
    assert second[2]["score"] is None and second[2]["rejected"]


def test_second_run_changes_nothing(spark, inputs, tmp_path):
    offers, pages, responses = inputs
    first = run_stages(offers, pages, responses, PROFILE, F.lit(NOW))
    path = tables.write_version(first.drop("topcard_text"), str(tmp_path / "offers"), 1)
    stored = tables.read_offers(spark, path)
    later = F.lit(NOW + dt.timedelta(days=1))
    again = run_stages(stored, pages, responses, PROFILE, later).drop("topcard_text")
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))


def test_page_status_routes(spark):
    pages = spark.createDataFrame([
        ("linkedin", "https://l/jobs/1", "<html><head></head> <body></body></html>"),
        ("linkedin", "https://l/authwall", "<p class='jobs-description__content'>x</p>"),
        ("linkedin", "https://l/jobs/2", "<p>short</p>"),
        ("linkedin", "https://l/jobs/3", "<p class='jobs-description__content'>x</p>"),
        ("linkedin", "https://l/jobs/4", f"<p>{'long text ' * 50}</p>"),
        ("apec", "https://a/emploi/detail-offre/1W",
         "<apec-offre-metadata>Ref. Apec : 1</apec-offre-metadata>" + "<div class='details-post'>d</div>" * 3),
        ("hellowork", "https://h/fr-fr/emplois/1.html", f"<h1>{'x' * 500}</h1>"),
        ("nowhere", "https://n", "<h1>x</h1>"),
        ("wttj", "https://w", None),
    ], "source string, url string, html string")
    judged = classify(pages).select("page_status", "url")
    assert [r[0] for r in judged.collect()] == [
        "shell_html", "challenge_or_login", "missing_job_markers", "ok", "ok", "few_details",
        "ok", "unknown_source", "empty_html"]
    assert accepted(judged).count() == 3 and rejects(judged).count() == 6
    with pytest.raises(Exception, match="page rejected: "):
        require_ok(judged).collect()


RELEVANCE = [
    (["ruby"], "<div>We are hiring a Ruby engineer.</div>", True),
    (["java"], "<div>JavaScript only</div>", False),
    (["data engineer"], "<b>Senior Data  Engineer</b> role", True),
    (["Ruby On Rails"], "<p>RUBY-on-RAILS</p>", True),
    (["c#"], "<p>Strong C# and .NET</p>", True),
    ([".net"], "<p>Strong C# and .NET</p>", True),
    (["java", "ruby"], "<p>ruby</p>", True),
    (["***", "  "], "<p>Backend</p>", True),
    ([], "", True),
    (["ruby"], "<p></p>", False),
    (["c++"], "<p>C&#43;&#43; dev</p>", True),
    (["ruby"], "<a title='x>ruby'>y</a><!-- ruby -->", False),
    (["caf"], "<p>caf&eacute;</p>", True),
]


def test_relevance(spark):
    rows = spark.createDataFrame(
        [(k, h) for k, h, _ in RELEVANCE], "keywords array<string>, html string")
    found = rows.select(is_relevant(F.col("keywords"), page_words(F.col("html")))).collect()
    assert [r[0] for r in found] == [e for *_, e in RELEVANCE]
    plain = relevance_flag(
        spark.createDataFrame([(["go"], None), (["go"], "Go!")], "k array<string>, t string"),
        F.col("t"), F.col("k")).select("relevant").collect()
    assert [r[0] for r in plain] == [False, True]


# --- page store ---------------------------------------------------------------

def stored_page(i, html, day, version=1):
    return (f"h{i}", f"https://x/{i}", "apec", html, None if day is None else T0 + dt.timedelta(days=day), version)


def test_page_store_touches_only_what_a_fetch_changes(spark, tmp_path):
    import glob
    import os

    path = str(tmp_path / "store")
    tables.create_page_store(spark.createDataFrame([stored_page(i, f"old {i}", 1) for i in range(40)], schemas.RAW_PAGES), path, 8)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    fetch = [stored_page(3, "new 3", 2), stored_page(3, "newer 3", 3), stored_page(3, "newer 3", 3), stored_page(50, "first", 2),
             stored_page(4, "older", 0), stored_page(5, "old 5", 1), stored_page(6, "no time", None), stored_page(7, "v2", 1, 2)]
    fetched = spark.createDataFrame(fetch, schemas.RAW_PAGES)
    touched = tables.update_page_store(spark, path, fetched, 8)
    found = {r["url_hash"]: r["html"] for r in tables.read_page_store(spark, path).collect()}
    want = {f"h{i}": f"old {i}" for i in range(40)} | {"h3": "newer 3", "h50": "first", "h7": "v2"}
    assert found == want and 0 < len(touched) < 8
    assert tables.read_page_store(spark, path).count() == len(want)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and all(after[f] == before[f] for f in kept)
    tables.update_page_store(spark, path, fetched, 8)
    assert {r["url_hash"]: r["html"] for r in tables.read_page_store(spark, path).collect()} == want
    assert tables.update_page_store(spark, path, fetched.limit(0), 8) == []


# --- streaming ---------------------------------------------------------------

def crawled(run, page, more, keyword="Ruby", urls=3):
    found = [f"https://x/{run}/{(page * 7 + i) % 5}?q" for i in range(urls)]
    return ("linkedin", keyword, run, page, found, more, T0 + dt.timedelta(minutes=10 * page + len(keyword)))


def test_streamed_discovery_is_resumed_by_page(spark, tmp_path, monkeypatch):
    from offerloom.streaming import discovery as module

    monkeypatch.setattr(module, "MERGE_EVERY", 2)
    turns = [
        [crawled("a", p, True) for p in (1, 2)] + [crawled("b", 1, True, "Go lang")],
        [crawled("a", 3, True), crawled("b", 2, False, "Go lang"), crawled("b", 3, True, "late", 1)],
        [crawled("a", 3, True), crawled("a", 4, True), crawled("b", 4, True, "past the end", 1)],
        [crawled("a", p, True) for p in range(5, 13)] + [crawled("a", 1, False, "again", 1)],
    ]
    source, root, cp = (str(tmp_path / n) for n in ("crawl", "run", "cp"))
    for number, rows in enumerate(turns):
        spark.createDataFrame(rows, schemas.CRAWL_RESULTS).coalesce(1).write.mode("append").parquet(source)
        if number % 2:  # the stream stops after two turns and is taken up again
            start_discovery(crawl_stream(spark, source, files_per_batch=1), root, cp, ["source", "work_mode"]).awaitTermination()
    found = Discovery(spark, root, ["source", "work_mode"])
    assert {r["work_mode"]: (r["page"], r["ended"]) for r in found.cursor().collect()} == {"a": (10, True), "b": (2, True)}
    counted = [r for turn in turns for r in turn if (r[2] == "a" and r[1] == "Ruby" and r[3] <= 10) or (r[2] == "b" and r[3] <= 2)]
    empty = spark.createDataFrame([], schemas.OFFERS)
    batch = discovery.upsert(empty, discovery.digest(discovery.sightings(spark.createDataFrame(counted, schemas.CRAWL_RESULTS))))
    streamed = discovery.upsert(empty, found.current())

    def facts(df):
        return sorted(
            (r["url"], sorted(r["keywords"]), r["last_seen_at"], r["steps_details"]["discovery"]["at"])
            for r in df.collect())

    assert facts(streamed) == facts(batch)
    assert sorted(found.digests.folders()) == [("batch", 2), ("batch", 3), ("upto", 1)]


def job_runs(spark, rows):
    item = '{"wrapped": "Sourcing::FetchJob"}'
    given = [(job, state, item if job != "x" else '{"class": "Other"}', T0 + dt.timedelta(seconds=at)) for job, state, at in rows]
    return spark.createDataFrame(given, "job string, state string, item string, at timestamp")


def test_live_status_takes_back_earlier_states(spark, tmp_path, monkeypatch):
    from offerloom.streaming import status as module

    monkeypatch.setattr(module, "MERGE_EVERY", 2)
    live = LiveStatus(spark, str(tmp_path))
    assert tuple(live.current().first()) == (False, 0, 0, None)
    steps = [
        ([("a", "queued", 1), ("b", "queued", 2), ("x", "queued", 2)], (True, 2, 0)),
        ([("a", "running", 3), ("c", "queued", 3), ("c", "running", 3)], (True, 1, 2)),
        ([("a", "queued", 1), ("a", "done", 9), ("a", "running", 4)], (True, 1, 1)),  # late and repeated rows
        ([("a", "running", 5), ("b", "failed", 9), (None, "queued", 9)], (True, 0, 1)),
        ([("c", "done", 10)], (False, 0, 0)),
        ([("a", "queued", 11)], (True, 1, 0)),  # the job is run again
    ]
    for number, (rows, want) in enumerate(steps):
        for _ in range(2):  # a batch that is run again changes nothing
            live.advance(job_runs(spark, rows), number)
            assert tuple(live.current().first())[:3] == want
    assert len(live.counts.folders()) == 2 and ("upto", 3) in live.jobs.folders()


def test_upsert_by_key_or_url(spark):
    def stored(i, url, key):
        row = list(offer(i, "apec", ["old"]))
        names = [f.name for f in schemas.OFFERS.fields]
        row[names.index("url")], row[names.index("url_hash")] = url, key
        return tuple(row)

    offers = spark.createDataFrame([stored(1, "u1", "k1"), stored(2, "u2", "other"), stored(3, "u3", "k3"), stored(4, "u3", "z3")], schemas.OFFERS)
    later = T0 + dt.timedelta(days=1)
    incoming = spark.createDataFrame([
        ("k1", "u1", "wttj", ["new"], T0, later), ("k2", "u2", "wttj", ["x"], T0, later), ("other", "u2 moved", "linkedin", ["y"], T0, T0),
        ("n3", "u3", "wttj", ["old", "z"], T0, later), ("k5", "u5", "wttj", ["five"], T0, later)],
        "url_hash string, url string, source string, keywords array<string>, first_at timestamp, last_at timestamp")
    found = {r["url_hash"]: (r["url"], r["source"], r["keywords"], r["last_seen_at"]) for r in discovery.upsert(offers, incoming).collect()}
    assert found == {
        "k1": ("u1", "wttj", ["old", "new"], later),
        "other": ("u2 moved", "linkedin", ["old", "y", "x"], later),  # claimed by key and by url
        "k3": ("u3", "apec", ["old", "z"], later),  # the least key that has the url
        "z3": ("u3", "apec", ["old"], T0),
        "k5": ("u5", "wttj", ["five"], later),
    }
    steady = incoming.where("url_hash not in ('k2', 'other')")
    once = discovery.upsert(offers, steady)
    assert rows_of(discovery.upsert(once, steady)) == rows_of(once)


def streamed_chain(spark, folder, batches, profile=PROFILE):
    """The chain over lists of (offers, pages, responses), one micro-batch each."""
    for some in batches:
        chain_events(*some).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    schema = spark.read.parquet(f"{folder}/events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    start_chain(stream, f"{folder}/chain", f"{folder}/cp", profile, lambda: F.lit(NOW)).awaitTermination()
    return Chain(spark, f"{folder}/chain")


def rows_of(offers):
    return sorted(str(r) for r in offers.select(*schemas.OFFERS.fieldNames()).collect())


ORDERS = [
    [("responses",), ("pages",), ("offers",)],
    [("offers", "responses"), ("responses",), ("pages",), ("offers", "pages", "responses")],
]


@pytest.mark.parametrize("order", range(len(ORDERS)))
def test_streamed_chain_equals_batch_in_any_order(spark, inputs, tmp_path, order):
    parts = dict(zip(("offers", "pages", "responses"), inputs))
    batches = [[parts[n] if n in names else parts[n].limit(0) for n in parts] for names in ORDERS[order]]
    chain = streamed_chain(spark, str(tmp_path), batches)
    want = run_stages(*inputs, PROFILE, F.lit(NOW)).drop("topcard_text")
    assert rows_of(chain.current()) == rows_of(want)
    last = max(n for _, n in chain.open.folders())
    waiting = {r["id"] for r in chain.open.last(last + 1).collect()}
    assert waiting == {5, 8}  # without a page, without a response
    assert chain.pages.last(last + 1).count() == 0 and chain.responses.last(last + 1).count() == 0


def test_streamed_chain_repeats_and_merges(spark, inputs, tmp_path, monkeypatch):
    from offerloom.streaming import chain as module

    monkeypatch.setattr(module, "MERGE_EVERY", 2)
    offers, pages, responses = inputs
    none = [t.limit(0) for t in inputs]
    steps = [
        [offers.where("id < 5"), none[1], responses], [offers.where("id > 3"), pages.where("url_hash = 'h1'"), none[2]],
        [none[0], pages, none[2]], [offers, pages, none[2]], [none[0], none[1], responses]]
    chain, args = Chain(spark, str(tmp_path)), (PROFILE, F.lit(NOW))
    for number, some in enumerate(steps):
        chain.advance(chain_events(*some), number, *args)
        before = rows_of(chain.current())
        chain.advance(chain_events(*some), number, *args)  # as after a failure before the commit
        assert rows_of(chain.current()) == before
    assert before == rows_of(run_stages(*inputs, *args).drop("topcard_text"))
    assert sorted(chain.log.folders()) == [("batch", 4), ("upto", 3)]
    assert len(chain.open.folders()) <= 2


def test_streamed_chain_plans_the_stages_once_and_parses_only_pages(spark, inputs, tmp_path, monkeypatch):
    from offerloom.streaming.batches import Batches

    plans, write = [], Batches.write

    def recorded(self, rows, number):
        if self.path.endswith("/offers"):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows, number)

    monkeypatch.setattr(Batches, "write", recorded)
    offers, pages, responses = inputs
    chain = Chain(spark, str(tmp_path))
    for number, some in enumerate([[offers, pages.limit(0), responses], [offers.limit(0), pages, responses.limit(0)]]):
        chain.advance(chain_events(*some), number, PROFILE, F.lit(NOW))
    assert not any("Exchange" in plan for plan in plans)
    assert ["ArrowEvalPython" in plan for plan in plans] == [False, True]
    assert rows_of(chain.current()) == rows_of(run_stages(*inputs, PROFILE, F.lit(NOW)).drop("topcard_text"))


def test_streamed_throttle_equals_batch(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [("k", base + dt.timedelta(milliseconds=370 * i)) for i in range(50)]
    rows += [("j", base + dt.timedelta(milliseconds=999 * i)) for i in range(9)]
    source = str(tmp_path / "events")
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(source)
    out = str(tmp_path / "out")
    throttled_stream(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = throttled(spark.createDataFrame(rows, "key string, ts timestamp"))
    assert sorted(map(tuple, spark.read.parquet(out).select("key", "ts").collect())) == sorted(
        map(tuple, batch.select("key", "ts").collect()))
