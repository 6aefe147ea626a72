"""Offer-shaped views over the supplied tables, in Spark and as DuckDB CTEs.

Both forms of a view must give the same rows; the catalogue compares engines on
top of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom.functions.arrays import iso, or_empty, steps_from_columns
from offerloom.functions.text import url_key

NOW_TEXT = "2001-08-15 12:00:00"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def source_of(priority: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", "linkedin")
        .when(priority == "2-HIGH", "france_travail")
        .when(priority == "3-MEDIUM", "cadremploi")
        .when(priority == "4-NOT SPECIFIED", "hellowork")
        .otherwise("apec")
    )


def offers_base(spark: SparkSession, folder: str) -> DataFrame:
    """Offers from orders alone (narrow scan)."""
    key = F.col("o_orderkey")
    seen = F.col("o_orderdate").cast("timestamp")
    url = F.concat(F.lit("https://example.com/jobs/"), key.cast("string"))
    at = iso(seen)

    def kept(n: int) -> Column:
        return F.when(key % n != 0, at)

    steps = steps_from_columns(
        {"discovery": at, "fetch": kept(2), "analyze": kept(3), "enrich": kept(5), "score": kept(7)})
    version = (key % 2 + 1).cast("int")
    return table(spark, folder, "orders").select(
        key.alias("id"),
        F.col("o_custkey"),
        F.col("o_totalprice"),
        source_of(F.col("o_orderpriority")).alias("source"),
        F.when(key % 4 == 0, "remote").when(key % 4 == 1, "hybrid").when(key % 4 == 2, "on-site")
        .alias("location_mode"),
        F.when((key % 4 == 1) & (key % 3 != 0), (key % 5 + 1).cast("int"))
        .alias("hybrid_remote_days_min_per_week"),
        url.alias("url"),
        url_key(url).alias("url_hash"),
        F.when(key % 11 != 0, F.concat(F.lit("Engineer "), (key % 50).cast("string")))
        .alias("title"),
        seen.alias("first_seen_at"),
        (seen + F.expr("INTERVAL 3 DAYS")).alias("last_seen_at"),
        (F.col("o_orderstatus") == "P").alias("rejected"),
        F.when(key % 7 != 0, (key % 101).cast("int")).alias("score"),
        F.transform_values(
            steps,
            lambda k, v: F.when(k == "discovery", v).otherwise(
                F.struct(v["at"].alias("at"), version.alias("version"))),
        ).alias("steps_details"),
    )


BASE_SQL = """base AS (
  SELECT o_orderkey AS id, o_custkey, o_totalprice,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'linkedin' WHEN '2-HIGH' THEN 'france_travail'
      WHEN '3-MEDIUM' THEN 'cadremploi' WHEN '4-NOT SPECIFIED' THEN 'hellowork' ELSE 'apec' END AS source,
    CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'on-site' END AS location_mode,
    CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 5 END
      AS hybrid_remote_days_min_per_week,
    'https://example.com/jobs/' || o_orderkey AS url,
    sha256('https://example.com/jobs/' || o_orderkey) AS url_hash,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'Engineer ' || (o_orderkey % 50) END AS title,
    o_orderdate AS first_seen_at, o_orderdate + INTERVAL 3 DAY AS last_seen_at,
    o_orderstatus = 'P' AS rejected,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 101 END AS score,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS step_at,
    1 + o_orderkey % 2 AS step_version
  FROM orders)"""


def with_places(offers: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add company and city (customer and nation names)."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company"), "c_nationkey")
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return (
        offers.join(customer, "o_custkey", "left").join(nation, "c_nationkey", "left")
        .drop("c_nationkey")
    )


PLACES_SQL = """places AS (
  SELECT base.*, c_name AS company, n_name AS city FROM base
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def with_technologies(offers: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add technology arrays: distinct part names of an order's lines.

    collect_set merges inside every task, so even an order with very many lines
    only ships its distinct names.
    """
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    name = F.when(
        F.col("l_orderkey") % 5 == 0,
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")),
    ).otherwise(F.col("p_name"))
    first_lines = F.col("l_linenumber") <= 2
    named = (
        table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        .join(parts, "l_partkey").withColumn("name", name)
    )
    lists = named.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_set(F.when(first_lines, F.col("name")))).alias("_first"),
        F.sort_array(F.collect_set(F.when(~first_lines, F.col("name")))).alias("_rest"),
    )
    return offers.join(lists, "id", "left").withColumns({
        "primary_technologies": or_empty(F.col("_first")),
        "secondary_technologies": or_empty(F.col("_rest")),
    }).drop("_first", "_rest")


TECHNOLOGIES_SQL = """named AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0
    THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END AS name
  FROM lineitem JOIN part ON p_partkey = l_partkey),
lists AS (
  SELECT l_orderkey,
    list_sort(list(DISTINCT name) FILTER (WHERE l_linenumber <= 2)) AS first_names,
    list_sort(list(DISTINCT name) FILTER (WHERE l_linenumber > 2)) AS rest_names
  FROM named GROUP BY l_orderkey),
offers AS (
  SELECT places.*, coalesce(first_names, CAST([] AS VARCHAR[])) AS primary_technologies,
    coalesce(rest_names, CAST([] AS VARCHAR[])) AS secondary_technologies
  FROM places LEFT JOIN lists ON l_orderkey = id)"""

OFFERS_SQL = f"{BASE_SQL},\n{PLACES_SQL},\n{TECHNOLOGIES_SQL}"


def offers_view(spark: SparkSession, folder: str) -> DataFrame:
    return with_technologies(
        with_places(offers_base(spark, folder), spark, folder), spark, folder)


# --- sightings, crawl results, job runs --------------------------------------

def crawl_view(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl pages from events: twelve consecutive ids make a run."""
    run = F.floor(F.col("event_id") / 12)
    links = F.array(
        F.concat(F.lit("https://jobs.example.com/o/"), F.col("user_id").cast("string"),
                 F.lit("?ref="), F.col("event_type")),
        F.concat(F.lit("https://jobs.example.com/o/"),
                 ((F.col("user_id") * 7 + F.col("event_id") % 5) % 1000).cast("string"),
                 F.lit("#top")),
    )
    return table(spark, folder, "events").select(
        F.element_at(F.array(*[F.lit(s) for s in CRAWLED]), (run % 5 + 1).cast("int"))
        .alias("source"),
        F.concat(F.lit("Kw-"), F.col("event_type"), F.lit(" "), (run % 3).cast("string"))
        .alias("keyword"),
        F.concat(F.lit("run "), run.cast("string")).alias("work_mode"),
        (F.col("event_id") % 12 + 1).cast("int").alias("page"),
        links.alias("discovered_urls"),
        (F.col("value") < 60).alias("has_next_page"),
        F.col("ts").cast("timestamp").alias("discovered_at"),
    )


CRAWLED = ["linkedin", "hellowork", "apec", "cadremploi", "wttj"]
CRAWL_SQL = """crawl AS (
  SELECT list_extract(['linkedin','hellowork','apec','cadremploi','wttj'],
      CAST(event_id // 12 % 5 + 1 AS INTEGER)) AS source,
    'Kw-' || event_type || ' ' || (event_id // 12 % 3) AS keyword,
    'run ' || (event_id // 12) AS work_mode,
    CAST(event_id % 12 + 1 AS INTEGER) AS page,
    ['https://jobs.example.com/o/' || user_id || '?ref=' || event_type,
     'https://jobs.example.com/o/' || ((user_id * 7 + event_id % 5) % 1000) || '#top'] AS links,
    value < 60 AS has_next_page, ts AS discovered_at
  FROM events),
flat AS (
  SELECT source, keyword, page, discovered_at, unnest([0, 1]) AS position, unnest(links) AS raw_url
  FROM crawl),
cleaned AS (
  SELECT source, page, position, discovered_at,
    CASE WHEN source IN ('linkedin','hellowork','apec') THEN regexp_replace(raw_url, '[?#].*$', '')
      WHEN source = 'cadremploi' THEN regexp_replace(raw_url, '#.*$', '') ELSE raw_url END AS url,
    trim(regexp_replace(lower(regexp_replace(keyword, '[^a-zA-Z\\s]', ' ', 'g')), '\\s+', ' ', 'g'))
      AS keyword
  FROM flat),
sightings AS (
  SELECT sha256(url) AS url_hash, url, source, keyword, discovered_at AS seen_at,
    {'a': discovered_at, 'b': page, 'c': position, 'd': source} AS seq FROM cleaned)"""


def job_runs_view(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    item = (
        F.when(kind == "click", F.concat(
            F.lit('{"wrapped":"Sourcing::'), F.initcap(kind), F.lit('Job","class":"Wrapper"}')))
        .when(kind == "view", F.concat(
            F.lit('{"class":"Wrapper","args":[{"job_class":"Sourcing::'), F.initcap(kind),
            F.lit('Job"}]}')))
        .when(kind == "error", F.lit('{"class":"Sourcing::ErrorJob","args":["x"]}'))
        .otherwise(F.concat(F.lit('{"class":"Other::'), F.initcap(kind), F.lit('"}')))
    )
    state = F.element_at(
        F.array(F.lit("queued"), F.lit("running"), F.lit("done")),
        (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, folder, "events").select(
        "event_id", state.alias("state"), item.alias("item"),
        F.col("ts").cast("timestamp").alias("at"))


JOB_CLASS_SQL = """jobs AS (
  SELECT event_id, list_extract(['queued','running','done'], CAST(event_id % 3 + 1 AS INTEGER)) AS state,
    CASE event_type WHEN 'click' THEN 'Sourcing::ClickJob' WHEN 'view' THEN 'Sourcing::ViewJob'
      WHEN 'error' THEN 'Sourcing::ErrorJob'
      ELSE 'Other::' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS job_class
  FROM events)"""


# --- texts chosen by key -------------------------------------------------------

def pick(texts: list[str], key: Column) -> Column:
    """One of a list of texts, by key: input that grows with the table."""
    return F.element_at(
        F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(texts: list[str], key: str) -> str:
    items = ", ".join(sql_text(t) for t in texts)
    return f"list_extract([{items}], CAST({key} % {len(texts)} + 1 AS INTEGER))"


def sql_pattern(pattern: str) -> str:
    return sql_text(pattern.replace("(?iu)", "(?i)"))


def sql_rules(expr: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    cases = " ".join(
        f"WHEN regexp_matches({expr}, {sql_pattern(p)}) THEN {sql_text(v)}" for p, v in rules)
    return f"CASE {cases} ELSE {default} END"
