"""Plans of the registered queries: what may and may not occur in them."""

import re

import pytest

from offerloom.plans.catalog import CATALOG

BATCH = [n for n in CATALOG if not n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_and_no_row_python(spark, small_tables, name):
    plan = plan_of(CATALOG[name].run(spark, small_tables))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan, forbidden


def scans(plan):
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_narrow_queries_read_narrow(spark, small_tables):
    plan = plan_of(CATALOG["top_sources"].run(spark, small_tables))
    (scan,) = scans(plan)
    assert "ReadSchema: struct<o_orderpriority:string>" in scan


def test_dashboard_is_one_scan(spark, small_tables):
    for name in ("dashboard", "dashboard_totals"):
        assert len(scans(plan_of(CATALOG[name].run(spark, small_tables)))) == 1


def test_lookup_is_pushed_to_the_scan(spark, small_tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = plan_of(CATALOG["offer_lookup"].run(spark, small_tables))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(o_orderkey,1)" in plan


def test_search_page_is_a_top_k(spark, small_tables):
    assert "TakeOrderedAndProject" in plan_of(CATALOG["search_page"].run(spark, small_tables))


def test_scoring_adds_no_join(spark, small_tables):
    """The profile is part of the expressions; only the view's own joins remain."""
    plan = plan_of(CATALOG["score_offers"].run(spark, small_tables))
    assert len([line for line in plan.splitlines() if "Join" in line]) == 4


def test_extraction_parses_once_and_does_not_shuffle(spark, small_tables):
    from pyspark.sql import functions as F

    from offerloom.operators.extract import extract

    pages = spark.read.parquet(f"{small_tables}/pages.parquet").select(
        F.lit("apec").alias("source"), "html")
    plan = plan_of(extract(pages, F.current_timestamp(), sources=["apec"]))
    assert plan.count("ArrowEvalPython") == 2 and "MapInArrow" not in plan and "Exchange" not in plan


def test_chain_shuffles_on_the_url_key_only_and_before_the_parser(spark):
    from pyspark.sql import functions as F

    from offerloom import schemas
    from offerloom.plans.catalog_search import PROFILE
    from offerloom.plans.flow import run_stages

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        offers = spark.createDataFrame([], schemas.OFFERS)
        pages = spark.createDataFrame([], schemas.RAW_PAGES)
        responses = spark.createDataFrame([], schemas.MODEL_RESPONSES)
        plan = plan_of(run_stages(offers, pages, responses, PROFILE, F.current_timestamp())).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(exchanges) == 3 and all("hashpartitioning(url_hash" in plan[i] for i in exchanges)
    (parser,) = [i for i, line in enumerate(plan) if "ArrowEvalPython [_parsed(" in line]
    assert re.search(r"ArrowEvalPython \[_parsed\(CASE WHEN _run#\d+ THEN html#\d+ END\)#", plan[parser])
    assert parser < exchanges[0] and not any("InArrow" in line for line in plan)


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from offerloom.plans.catalog_chain import chain_inputs
    from offerloom.plans.catalog_search import PROFILE
    from offerloom.plans.flow import run_stages
    from offerloom.sources.tables import write_bucketed

    inputs = chain_inputs(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = [write_bucketed(t, f"bucketed_{n}", f"{tmp_path}/{n}", 4) for n, t in zip(("offers", "pages", "responses"), inputs)]
        done = run_stages(*tables, PROFILE, F.lit("2026-01-01").cast("timestamp"))
        assert "Exchange" not in plan_of(done)
        plain = run_stages(*inputs, PROFILE, F.lit("2026-01-01").cast("timestamp"))
        assert sorted(map(str, done.select("id", "score").collect())) == sorted(map(str, plain.select("id", "score").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in ("offers", "pages", "responses"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{n}")
