"""Registered queries: crawl plan, crawl results, upsert, page store."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.fixed_values import FRANCE_TRAVAIL_HOST
from offerloom.functions import text
from offerloom.functions.arrays import iso
from offerloom.operators import discovery
from offerloom.operators.latest import latest_per_key
from offerloom.plans.registered import register
from offerloom import schemas
from offerloom.plans.views import (
    BASE_SQL,
    CRAWL_SQL,
    crawl_view,
    offers_base,
    pick,
    sql_pick,
    table,
    ts_text,
)
from offerloom.sources.tables import store_pages, with_pages

MODES = ["remote", "hybrid", "on-site"]
KEYWORD_TEXTS = ["C++ dev", "data  engineer ", "Ruby-on-Rails", "node.js*", "élan~x", "", "a&b=c"]


def keyword_rows(spark, folder):
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("n"),
        pick(KEYWORD_TEXTS, F.col("n_nationkey")).alias("keyword"))


_PLAN_SQL = f"""keywords AS (
  SELECT CAST(n_nationkey AS BIGINT) AS n, {sql_pick(KEYWORD_TEXTS, 'n_nationkey')} AS keyword FROM nation),
targets(source, work_mode) AS (VALUES
  ('linkedin','remote'), ('linkedin','hybrid'), ('linkedin','on-site'), ('france_travail','remote'),
  ('cadremploi','remote'), ('cadremploi','hybrid'), ('cadremploi','on-site'), ('hellowork','remote'),
  ('apec','remote'), ('apec','hybrid'), ('apec','on-site')),
plan AS (SELECT source, keyword, work_mode, n FROM keywords, targets)"""


@register("launch_plan", "O-JN-5 O-PRJ-7", f"WITH {_PLAN_SQL} SELECT * FROM plan")
def launch_plan(spark, folder):
    return discovery.launch_plan(keyword_rows(spark, folder), MODES)


_FORM = "replace(replace(replace(url_encode({0}), '%20', '+'), '~', '%7E'), '%2A', '*')"
_QUERY = "replace(url_encode({0}), '%20', '+')"


@register("search_urls", "O-DSC-5", f"""WITH {_PLAN_SQL},
pages AS (SELECT *, trim(keyword) AS kw,
  unnest(range(1, 1 + CASE source WHEN 'france_travail' THEN 1 WHEN 'apec' THEN 25 ELSE 10 END)) AS page FROM plan)
SELECT source, keyword, work_mode, n, CAST(page AS BIGINT) AS page, CASE source
  WHEN 'linkedin' THEN 'https://www.linkedin.com/jobs/search/?keywords=' || {_FORM.format('keyword')}
    || '&start=' || (page - 1) * 25 || '&f_WT=' || CASE work_mode WHEN 'remote' THEN '2' WHEN 'hybrid' THEN '3' ELSE '1' END
  WHEN 'hellowork' THEN 'https://www.hellowork.com/fr-fr/emploi/recherche.html'
    || CASE WHEN kw = '' AND page = 1 THEN '' ELSE '?' END || CASE WHEN kw = '' THEN '' ELSE 'k=' || {_FORM.format('kw')} END
    || CASE WHEN kw <> '' AND page > 1 THEN '&' ELSE '' END || CASE WHEN page > 1 THEN 'p=' || page ELSE '' END
  WHEN 'apec' THEN CASE WHEN work_mode = 'on-site' THEN NULL ELSE
    'https://www.apec.fr/candidat/recherche-emploi.html/emploi?typesConvention=143684&typesConvention=143685'
    || '&typesConvention=143686&typesConvention=143687&typesConvention=143706'
    || CASE WHEN kw = '' THEN '' ELSE '&motsCles=' || {_FORM.format('kw')} END || '&page=' || (page - 1)
    || CASE work_mode WHEN 'remote' THEN '&typesTeletravail=20767' ELSE '&typesTeletravail=20765&typesTeletravail=20766' END END
  WHEN 'cadremploi' THEN 'https://www.cadremploi.fr/emploi/liste_offres'
    || CASE WHEN kw = '' AND page = 1 THEN '' ELSE '?' END
    || CASE WHEN kw = '' THEN '' ELSE 'motsCles=' || {_FORM.format('kw')} || '&motscles=' || {_FORM.format('(upper(kw[1]) || kw[2:])')} END
    || CASE WHEN kw <> '' AND page > 1 THEN '&' ELSE '' END || CASE WHEN page > 1 THEN 'page=' || page ELSE '' END
  ELSE 'https://candidat.francetravail.fr/offres/recherche?motsCles=' || {_QUERY.format('keyword')}
    || '&offresPartenaires=true&rayon=10&tri=0' END AS search_url
FROM pages""")
def search_urls(spark, folder):
    """Every page that a source may be crawled for."""
    plan = discovery.launch_plan(keyword_rows(spark, folder), MODES)
    return discovery.with_search_urls(plan).withColumn("page", F.col("page").cast("long"))


MODE_TEXTS = ["remote", "Hybrid", "on-site", "onsite", "hybrid", ""]


@register("mode_violations", "O-DSC-6", f"""
SELECT * FROM (SELECT s_suppkey AS id, {sql_pick(MODE_TEXTS, 's_suppkey')} AS work_mode FROM supplier)
WHERE work_mode NOT IN ('remote', 'hybrid', 'on-site')""")
def mode_violations(spark, folder):
    rows = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), pick(MODE_TEXTS, F.col("s_suppkey")).alias("work_mode"))
    return discovery.mode_violations(rows)


LISTS = [" a, b ,,a", "remote,hybrid", " , ,", "x", "ruby , node.js,ruby ,\tgo", ""]


@register("list_parameter", "O-SRC-7", f"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter(
  list_transform(string_split(raw, ','), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''))), '|') AS items
FROM (SELECT c_custkey AS id, {sql_pick(LISTS, 'c_custkey')} AS raw FROM customer)""")
def list_parameter(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), pick(LISTS, F.col("c_custkey")).alias("raw"))
    return rows.select(
        "id", F.array_join(F.sort_array(text.parse_list(F.col("raw"))), "|").alias("items"))


@register("canonical_urls", "O-DSC-1 O-DSC-2", """
SELECT page_id, CASE page_id % 6 WHEN 4 THEN regexp_replace(url, '#.*$', '')
    WHEN 3 THEN 'https://candidat.francetravail.fr' || regexp_replace(url, '^https?://[^/]+', '')
    WHEN 5 THEN url ELSE regexp_replace(url, '[?#].*$', '') END AS canonical,
  sha256(canonical) AS url_hash FROM pages""")
def canonical_urls(spark, folder):
    sources = ["linkedin", "hellowork", "apec", "france_travail", "cadremploi", "wttj"]
    source = pick(sources, F.col("page_id"))
    raw = F.when(
        source == "france_travail", F.regexp_replace("url", "^https?://[^/]+", "")
    ).otherwise(F.col("url"))
    cleaned = table(spark, folder, "pages").select(
        "page_id", text.canonical_url(source, raw, FRANCE_TRAVAIL_HOST).alias("canonical"))
    return cleaned.withColumn("url_hash", text.url_key(F.col("canonical")))


@register("clean_keywords", "O-DSC-3", """
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z\\s]', ' ', 'g')), '\\s+', ' ', 'g')) AS keyword
FROM documents""")
def clean_keywords(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.keyword(F.col("text")).alias("keyword"))


# --- crawl results -----------------------------------------------------------

@register("paging_stop", "O-WIN-1", f"""WITH {CRAWL_SQL},
capped AS (SELECT * FROM crawl WHERE page <= CASE source WHEN 'apec' THEN 25 ELSE 10 END),
stops AS (SELECT work_mode AS run, min(page) AS stop FROM capped WHERE NOT has_next_page GROUP BY ALL)
SELECT source, keyword, work_mode, CAST(page AS BIGINT) AS page FROM capped
LEFT JOIN stops ON run = work_mode WHERE stop IS NULL OR page <= stop""")
def paging_stop(spark, folder):
    kept = discovery.crawled_pages(crawl_view(spark, folder), run=["source", "work_mode"])
    return kept.select("source", "keyword", "work_mode", F.col("page").cast("long").alias("page"))


@register("distinct_urls", "O-AGG-7", f"""WITH {CRAWL_SQL}
SELECT DISTINCT url_hash, url FROM sightings""")
def distinct_urls(spark, folder):
    return discovery.distinct_urls(discovery.sightings(crawl_view(spark, folder)))


_KEYWORDS_SQL = """firsts AS (SELECT url_hash, keyword, min(seq) AS seq FROM sightings
  WHERE keyword <> '' GROUP BY url_hash, keyword),
keyword_lists AS (SELECT url_hash, list(keyword ORDER BY seq, keyword) AS keywords FROM firsts GROUP BY url_hash)"""


@register("keyword_accumulate", "O-AGG-8", f"""WITH {CRAWL_SQL}, {_KEYWORDS_SQL}
SELECT url_hash, array_to_string(keywords, '|') AS keywords FROM keyword_lists""")
def keyword_accumulate(spark, folder):
    lists = discovery.keyword_lists(discovery.sightings(crawl_view(spark, folder)))
    return lists.select("url_hash", F.array_join("keywords", "|").alias("keywords"))


@register("seen_range", "O-AGG-9", f"""WITH {CRAWL_SQL}
SELECT url_hash, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM sightings GROUP BY url_hash""")
def seen_range(spark, folder):
    return discovery.seen_range(discovery.sightings(crawl_view(spark, folder))).select(
        "url_hash", ts_text(F.col("first_seen_at")).alias("first_seen_at"),
        ts_text(F.col("last_seen_at")).alias("last_seen_at"))


@register("discovery_upsert", "O-DSC-4 O-JN-2 O-AGG-8 O-AGG-9 O-SET-5", f"""WITH {CRAWL_SQL}, {_KEYWORDS_SQL},
old AS (SELECT sha256('https://jobs.example.com/o/' || c_custkey) AS url_hash,
    'https://jobs.example.com/o/' || c_custkey AS url, 'apec' AS source, c_custkey AS id,
    ['click', 'stored'] AS keywords, c_custkey % 2 = 0 AS has_step,
    CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2020-01-01' END AS seen
  FROM customer),
incoming AS (SELECT url_hash, arg_max(source, seq) AS source, any_value(url) AS url,
    min(seen_at) AS first_at, max(seen_at) AS last_at FROM sightings GROUP BY url_hash),
merged AS (SELECT coalesce(old.url_hash, incoming.url_hash) AS url_hash, incoming.url AS new_url, old.url AS old_url,
    coalesce(incoming.source, old.source) AS source, old.keywords AS old_keywords,
    old.has_step, old.seen, first_at, last_at
  FROM old FULL OUTER JOIN incoming ON old.url_hash = incoming.url_hash)
SELECT url_hash, coalesce(new_url, old_url) AS url, source,
  array_to_string(list_concat(coalesce(old_keywords, []), list_filter(coalesce(keywords, []),
    lambda k: NOT list_contains(coalesce(old_keywords, []), k))), '|') AS keywords,
  CASE WHEN has_step THEN '2020-01-01T00:00:00Z' WHEN new_url IS NULL THEN NULL
    ELSE strftime(first_at, '%Y-%m-%dT%H:%M:%SZ') END AS discovered_at,
  strftime(greatest(seen, last_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at
FROM merged LEFT JOIN keyword_lists USING (url_hash)""")
def discovery_upsert(spark, folder):
    url = F.concat(F.lit("https://jobs.example.com/o/"), F.col("c_custkey").cast("string"))
    at = F.lit("2020-01-01").cast("timestamp")
    step = F.create_map(
        F.lit("discovery"), F.struct(iso(at).alias("at"), F.lit(1).alias("version")))
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("apec").alias("source"), url.alias("url"),
        text.url_key(url).alias("url_hash"),
        F.array(F.lit("click"), F.lit("stored")).alias("keywords"),
        F.when(F.col("c_custkey") % 2 == 0, step).alias("steps_details"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("2025-01-01").cast("timestamp"))
        .otherwise(at).alias("last_seen_at"),
        F.lit(False).alias("rejected"),
        F.array().cast("array<string>").alias("primary_technologies"),
        F.array().cast("array<string>").alias("secondary_technologies"),
        at.alias("created_at"), at.alias("updated_at"),
    )
    incoming = discovery.digest(discovery.sightings(crawl_view(spark, folder)))
    return discovery.upsert(stored, incoming).select(
        "url_hash", "url", "source", F.array_join("keywords", "|").alias("keywords"),
        F.col("steps_details")["discovery"]["at"].alias("discovered_at"),
        ts_text(F.col("last_seen_at")).alias("last_seen_at"))


@register("upsert_by_url", "O-JN-2", """WITH known AS (
  SELECT c_custkey AS id, 'https://jobs.example.com/c/' || c_custkey AS url,
    sha256(CASE WHEN c_custkey % 3 = 0 THEN 'moved ' ELSE '' END || 'https://jobs.example.com/c/' || c_custkey) AS url_hash FROM customer),
seen AS (
  SELECT 'https://jobs.example.com/c/' || o_custkey AS url, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at
  FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'https://jobs.example.com/n/' || o_orderkey, o_orderdate, o_orderdate FROM orders WHERE o_orderkey % 50 = 0)
SELECT coalesce(known.id, -1) AS id, coalesce(known.url_hash, sha256(seen.url)) AS url_hash, coalesce(known.url, seen.url) AS url,
  CASE WHEN known.id IS NULL THEN 'new' WHEN seen.url IS NULL THEN 'old' ELSE 'old|new' END AS keywords,
  CASE WHEN seen.url IS NULL OR known.id % 3 = 0 THEN 'apec' ELSE 'wttj' END AS source,
  strftime(greatest(CASE WHEN known.id IS NOT NULL THEN TIMESTAMP '1995-01-01' END, last_at), '%Y-%m-%d') AS last_seen
FROM known FULL JOIN seen ON known.url = seen.url""".replace("known.id % 3 = 0 THEN 'apec' ELSE 'wttj'", "coalesce(known.id % 3 = 0, false) THEN 'apec' ELSE 'wttj'"))
def upsert_by_url(spark, folder):
    """Every third stored url lies under a hash of its own: it is found by the url, keeps hash and source,
    and takes keywords and times."""
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://jobs.example.com/c/"), key)
    at = F.lit("1995-01-01").cast("timestamp")
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("apec").alias("source"), url.alias("url"),
        text.url_key(F.concat(F.when(F.col("c_custkey") % 3 == 0, "moved ").otherwise(""), url)).alias("url_hash"),
        F.array(F.lit("old")).alias("keywords"), F.create_map().cast(schemas.OFFERS["steps_details"].dataType).alias("steps_details"), at.alias("last_seen_at"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    again = orders.groupBy(F.concat(F.lit("https://jobs.example.com/c/"), F.col("o_custkey").cast("string")).alias("url")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    new = orders.where("o_orderkey % 50 = 0").select(
        F.concat(F.lit("https://jobs.example.com/n/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("at").alias("first_at"), F.col("at").alias("last_at"))
    incoming = again.union(new).select(
        text.url_key(F.col("url")).alias("url_hash"), "url", F.lit("wttj").alias("source"),
        F.array(F.lit("new")).alias("keywords"), "first_at", "last_at")
    merged = discovery.upsert(stored, incoming)
    return merged.select(
        F.when(F.array_contains("keywords", "old"), F.col("id")).otherwise(-1).alias("id"), "url_hash", "url",
        F.array_join("keywords", "|").alias("keywords"), "source",
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@register("latest_rows", "O-WIN-2", """
SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id,
  arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY user_id""")
def latest_rows(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(rows, "user_id", ["ts", "event_id"]).drop("ts")


# --- page store --------------------------------------------------------------

def fetched_pages(spark, folder):
    """Fetches from events: the page of user_id, fetched at ts."""
    url = F.concat(F.lit("https://example.com/jobs/"), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select(
        text.url_key(url).alias("url_hash"), url.alias("url"), F.lit("apec").alias("source"),
        F.concat(F.lit("<p>"), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"),
                 F.lit("</p>")).alias("html"),
        F.col("ts").cast("timestamp").alias("fetched_at"), F.lit(1).alias("version"))


_FETCHED_SQL = """fetched AS (
  SELECT 'https://example.com/jobs/' || user_id AS url,
    sha256('https://example.com/jobs/' || user_id) AS url_hash,
    '<p>' || event_type || ' ' || event_id || '</p>' AS html, ts FROM events),
stored AS (SELECT url_hash, any_value(url) AS url, arg_max(html, ts) AS html FROM fetched GROUP BY url_hash)"""


@register("store_pages", "O-SNK-2", f"""WITH {_FETCHED_SQL}
SELECT url_hash, url, html FROM stored""")
def stored_pages(spark, folder):
    fetched = fetched_pages(spark, folder)
    early = F.date_trunc("day", "fetched_at") < F.lit("2024-01-15").cast("timestamp")
    return store_pages(fetched.where(early), fetched.where(~early)).select(
        "url_hash", "url", "html")


@register("offers_with_pages", "O-SRC-3 O-JN-1", f"""WITH {BASE_SQL}, {_FETCHED_SQL}
SELECT id, base.source, html FROM base JOIN stored ON stored.url_hash = base.url_hash""")
def offers_with_pages(spark, folder):
    stored = stored_pages(spark, folder)
    return with_pages(offers_base(spark, folder), stored).select("id", "source", "html")
