"""Normalisers, profile documents, registry, quality messages."""

import json

import pytest
from pyspark.sql import functions as F

from offerloom import registry
from offerloom.functions import arrays, places, rules, salary, text
from offerloom.operators import enrich, quality
from offerloom.sources import profile as profiles
from offerloom.sources.markup import PageTokens


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_difference_keeps_duplicates(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b"])], "a array<string>, b array<string>")
    assert df.select(arrays.difference(F.col("a"), F.col("b"))).first()[0] == ["a", "a"]


def test_search_label_drops_capitals_first(spark):
    assert column(spark, ["PostgreSQL"], text.search_label) == ["ostgre"]
    assert column(spark, ["PostgreSQL"], lambda c: text.search_label(c, True)) == ["postgresql"]


def test_spaces(spark):
    odd = "  a  b c \t"
    assert column(spark, [odd], lambda c: text.collapse_for("linkedin", c)) == ["a b c"]
    assert column(spark, [odd], lambda c: text.collapse_for("hellowork", c)) == ["a b c"]
    assert column(spark, [" "], lambda c: text.collapse_for("apec", c)) == [None]


def test_accents_match_in_capitals(spark):
    assert column(spark, ["TÉLÉTRAVAIL TOTAL"], lambda c: rules.location_mode("hellowork", [c])) == [
        "remote"]
    assert column(spark, ["cdi", "CDI"], lambda c: rules.contract_type("cadremploi", c)) == [
        None, "PERMANENT"]


def test_linkedin_salary_text(spark):
    found = column(spark, [
        "Salary 50 000 - 60 000. EUR", "salary: $1,000.50 - $2,000.00", "pay range £90k to £120k",
        "salary USD 10 - 20", "Bonus EUR 60k - EUR 80k", "salaire 45 à 50 k€"],
        lambda c: salary.linkedin_text(c))
    assert [tuple(r) if r else None for r in found] == [
        None, (100050, 200000, "USD"), (9_000_000, 12_000_000, "GBP"), None, None, None]


def test_places(spark):
    assert column(spark, ["Greater Paris Metropolitan Region · x"], places.location_label) == [
        "Paris et périphérie"]
    assert column(spark, ["Senior Lead", "Lead Paris"], places.without_noise_prefix) == [
        "Senior Lead", "Paris"]


def test_step_map(spark):
    df = spark.createDataFrame([(None,), ({"fetch": ("a", 1)},)], "s map<string,struct<at:string,version:int>>")
    put = df.select(arrays.put_step(F.col("s"), "fetch", F.lit("b"), F.lit(2))).collect()
    assert [r[0]["fetch"] for r in put] == [("b", 2), ("b", 2)]


def test_registry():
    assert [s.name for s in registry.active_sources()] == [
        "linkedin", "france_travail", "cadremploi", "hellowork", "apec"]
    assert registry.source("hellowork").version("analyze") == 2
    assert "city" not in registry.source("linkedin").analyzed_columns
    with pytest.raises(KeyError, match="nowhere"):
        registry.source("nowhere")


GOOD = {"technology": {"primary": ["ruby"], "secondary": []},
        "location": {"preference": ["remote"]}, "extra": True}


def test_profile_round_trip(spark, tmp_path):
    path = str(tmp_path / "profile")
    profiles.save_profile(spark, GOOD, path)
    assert profiles.load_profile(spark, path) == GOOD
    bad = json.loads(json.dumps(GOOD))
    bad["location"]["preference"] = ["remote", "office"]
    with pytest.raises(ValueError, match="Invalid location.preference"):
        profiles.save_profile(spark, bad, path)
    assert profiles.load_profile(spark, path) == GOOD


def test_list_parameter():
    assert profiles.list_parameter(" a, b,,a", None, "x") == ["a", "b"]
    assert profiles.list_parameter("", ["r ", "r", ""], "x") == ["r"]
    with pytest.raises(ValueError, match="at least one"):
        profiles.list_parameter(" , ", None, "KEYWORDS")
    with pytest.raises(ValueError, match="Missing required"):
        profiles.list_parameter(None, None, "technology.primary")


def test_steps_messages(spark):
    found = column(spark, ['{"fetch":{"at":null,"version":"2"},"x":1}', '"text"', None, '{"score":{}}'],
                   quality.steps_messages)
    assert found == [
        ["contains unsupported step x", "step fetch has an invalid at timestamp"],
        ["must be a hash"], [], []]


def test_strict_reference_empties_hybrid_days(spark):
    payload = F.lit('{"hybrid_remote_days_min_per_week":3}')
    for strict, days in ((False, 3), (True, None)):
        row = spark.range(1).select(enrich.normalised_response(
            F.lit("apec"), F.lit("hybrid"), payload, strict).alias("r")).first()["r"]
        assert row["hybrid_remote_days_min_per_week"] == days


def test_own_generator(spark):
    asked = spark.createDataFrame([("h1", "ruby job"), ("h2", "go job")], "url_hash string, prompt string")
    found = enrich.generate_responses(
        asked, lambda prompts: '{"city": "' + prompts.str.upper() + '"}').collect()
    assert sorted(map(tuple, found)) == [("h1", '{"city": "RUBY JOB"}'), ("h2", '{"city": "GO JOB"}')]


PAGES = [
    ("<p>a<p>b", "<p>a</p><p>b</p>", "ab"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "abc"),
    ("<b>x<i>y</b>z", "<b>x<i>y</i></b>z", "xyz"),
    ("a < b &amp; c", "a &lt; b &amp; c", "a < b & c"),
    ("<script>if (a < b) '</p>'</script>t", "<script>if (a < b) '</p>'</script>t", "if (a < b) '</p>'t"),
    ('<A HREF=x/y class=k>q</A>', '<a href="x/y">q</a>', "q"),
    ("<br/><svg><path d='1'/></svg>e", '<br><svg><path d="1"></path></svg>e', "e"),
    ("<!-- <p> -->x</div>y", "xy", "xy"),
    ('<a title="a>b">c</a>', '<a title="a&gt;b">c</a>', "c"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>", "abc"),
    ("x<p", "x", "x"),
    ("", "", ""),
]


@pytest.mark.parametrize("html,markup,plain", PAGES)
def test_page_tokens(html, markup, plain):
    page = PageTokens(html)
    assert page.markup() == markup and page.text() == plain
    for pos, tag in enumerate(page.tags):
        outer = "".join(page.out[page.m0[pos]:page.m1[pos]])
        assert outer.startswith(f"<{tag}") and page.t0[pos] <= page.t1[pos]
        assert page.parent[pos] < pos <= page.last[pos]


def test_hostile_markup_is_quick():
    import time

    start = time.perf_counter()
    for html in ("<a " * 20_000, "<" * 50_000, '<a x="' * 5_000, "<div>" * 20_000, "<!--" * 20_000):
        PageTokens(html)
    assert time.perf_counter() - start < 20
