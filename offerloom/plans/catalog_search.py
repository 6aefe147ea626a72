"""Registered queries: scan, search, projections, metrics, scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from offerloom.functions import arrays
from offerloom.functions.dates import preset_range
from offerloom.operators import metrics, score, search
from offerloom.plans.registered import register
from offerloom.plans.views import (
    BASE_SQL,
    OFFERS_SQL,
    PLACES_SQL,
    now,
    offers_base,
    offers_view,
    sql_text,
    table,
    ts_text,
    with_places,
    with_technologies,
)
from offerloom.registry import sources_table
from offerloom.schemas import SCORE_BREAKDOWN

NOW = dt.datetime(2001, 8, 15, 12, 0, 0)

# profile for the registered queries: half of the part names
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
PROFILE = {
    "technology": {
        "primary": [f"{a} {n}" for a in ("Blue", "red") for n in NOUNS],
        "secondary": [f"{a}-{n}" for a in ("old", "hot") for n in NOUNS],
    },
    "location": {
        "preference": ["remote", "hybrid", "on-site"],
        "city": ["NATION_1"],
        "hybrid": {"city": ["nation_1", "NATION_2"], "remote_days_min_per_week": 2.9},
        "on_site": {"city": ["Nation_3", "nation_5"]},
    },
}
KNOWN_SQL = "[" + ", ".join(
    sql_text(t.lower().replace(" ", "").replace("-", ""))
    for t in PROFILE["technology"]["primary"] + PROFILE["technology"]["secondary"]) + "]"


@register("offers_scan", "O-SRC-1", f"""WITH {BASE_SQL}
SELECT id, source, url, url_hash, location_mode, title, rejected,
  CAST(hybrid_remote_days_min_per_week AS BIGINT) AS days,
  strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM base""")
def offers_scan(spark, folder):
    return offers_base(spark, folder).select(
        "id", "source", "url", "url_hash", "location_mode", "title", "rejected",
        F.col("hybrid_remote_days_min_per_week").cast("long").alias("days"),
        ts_text(F.col("last_seen_at")).alias("last_seen_at"))


@register("offer_lookup", "O-SRC-2 O-FLT-1", f"""WITH {BASE_SQL}, {PLACES_SQL}
SELECT id, source, company, city, url FROM places WHERE NOT rejected AND id = 1""")
def offer_lookup(spark, folder):
    found = search.find_offer(offers_base(spark, folder), 1)
    return with_places(found, spark, folder).select("id", "source", "company", "city", "url")


@register("offer_list", "O-PRJ-1 O-PRJ-2", f"""WITH {BASE_SQL}, {PLACES_SQL}
SELECT id, title, company, city, source, location_mode, CAST(score AS BIGINT) AS score,
  strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM places""")
def offer_list(spark, folder):
    rows = with_places(offers_base(spark, folder).drop("first_seen_at"), spark, folder)
    return search.offer_list(rows).withColumns({
        "score": F.col("score").cast("long"),
        "first_seen_at": ts_text(F.col("first_seen_at")),
        "last_seen_at": ts_text(F.col("last_seen_at")),
    })


@register("offer_detail", "O-PRJ-1", f"""WITH {OFFERS_SQL}
SELECT id, title, company, city, url, source, location_mode, CAST(score AS BIGINT) AS score,
  array_to_string(primary_technologies, '|') AS primary_technologies,
  array_to_string(secondary_technologies, '|') AS secondary_technologies,
  strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM offers""")
def offer_detail(spark, folder):
    nothing = F.lit(None).cast("string")
    rows = offers_view(spark, folder).drop("first_seen_at").withColumns({
        c: nothing for c in (
            "employment_type", "score_breakdown", "description_html", "salary_min_minor",
            "salary_max_minor", "salary_currency", "posted_at")})
    return search.offer_detail(rows).select(
        "id", "title", "company", "city", "url", "source", "location_mode",
        F.col("score").cast("long").alias("score"),
        F.array_join("primary_technologies", "|").alias("primary_technologies"),
        F.array_join("secondary_technologies", "|").alias("secondary_technologies"),
        ts_text(F.col("first_seen_at")).alias("first_seen_at"))


@register("location_labels", "O-PRJ-4", f"""WITH {BASE_SQL}
SELECT id, CASE location_mode WHEN 'remote' THEN 'Remote' WHEN 'hybrid' THEN 'Hybrid'
  WHEN 'on-site' THEN 'On-site' ELSE 'Unknown' END AS label FROM base""")
def location_labels(spark, folder):
    return offers_base(spark, folder).select(
        "id", search.location_label(F.col("location_mode")).alias("label"))


def _step_sql(n, expr):
    return f"CASE WHEN id % {n} <> 0 THEN {expr} END"


@register("steps_expanded", "O-PRJ-3", f"""WITH {BASE_SQL}
SELECT id, step_at AS discovery_at, CAST(1 AS BIGINT) AS discovery_version,
  {_step_sql(2, 'step_at')} AS fetch_at, {_step_sql(2, 'step_version')} AS fetch_version,
  {_step_sql(3, 'step_at')} AS analyze_at, {_step_sql(3, 'step_version')} AS analyze_version,
  {_step_sql(5, 'step_at')} AS enrich_at, {_step_sql(5, 'step_version')} AS enrich_version,
  {_step_sql(7, 'step_at')} AS score_at, {_step_sql(7, 'step_version')} AS score_version
FROM base""")
def steps_expanded(spark, folder):
    rows = offers_base(spark, folder).select(
        "id", search.steps_struct(F.col("steps_details")).alias("s"))
    return rows.select("id", *[
        c for step in ("discovery", "fetch", "analyze", "enrich", "score") for c in (
            F.col(f"s.{step}.at").alias(f"{step}_at"),
            F.col(f"s.{step}.version").cast("long").alias(f"{step}_version"))])


@register("technology_list", "O-PRJ-6 O-SET-3", f"""WITH {OFFERS_SQL}
SELECT id, array_to_string(list_sort(list_distinct(
  list_concat(primary_technologies, secondary_technologies))), '|') AS technologies FROM offers""")
def technology_list(spark, folder):
    listed = search.technology_list(F.col("primary_technologies"), F.col("secondary_technologies"))
    return offers_view(spark, folder).select(
        "id", F.array_join(F.sort_array(listed), "|").alias("technologies"))


@register("source_keys", "O-PRJ-7 O-UDF-1", f"""WITH {BASE_SQL},
keys(source, active, page_cap) AS (VALUES ('linkedin', true, 10), ('france_travail', true, 1),
  ('cadremploi', true, 10), ('hellowork', true, 10), ('apec', true, 25), ('wttj', false, 10)),
counts AS (SELECT source, count(*) AS n FROM base GROUP BY source)
SELECT keys.source, active, CAST(page_cap AS BIGINT) AS page_cap, coalesce(n, 0) AS offers
FROM keys LEFT JOIN counts ON counts.source = keys.source""")
def source_keys(spark, folder):
    counts = offers_base(spark, folder).groupBy("source").agg(F.count("*").alias("n"))
    return sources_table(spark).join(counts, "source", "left").select(
        "source", "active", F.col("page_cap").cast("long").alias("page_cap"),
        F.coalesce("n", F.lit(0)).alias("offers"))


# --- search ------------------------------------------------------------------

PAGE_COLUMNS_SQL = """id, title, company, source, location_mode, CAST(score AS BIGINT) AS score,
  strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at"""


def page_columns(rows):
    return rows.select(
        "id", "title", "company", "source", "location_mode",
        F.col("score").cast("long").alias("score"),
        ts_text(F.col("first_seen_at")).alias("first_seen_at"))


@register("search_page", "O-FLT-1 O-SRT-1 O-SRT-2", f"""WITH {BASE_SQL}, {PLACES_SQL}
SELECT {PAGE_COLUMNS_SQL} FROM places WHERE NOT rejected
ORDER BY places.first_seen_at DESC NULLS LAST, id LIMIT 25 OFFSET 25""")
def search_page(spark, folder):
    rows = with_places(offers_base(spark, folder), spark, folder)
    return page_columns(search.search_page(rows, search.SearchParams(page=2)))


TECH_TERMS = ["Blue Bolt", "red-ring", "hot rod"]


def _overlap_sql(column, fold):
    inner = ("regexp_replace(lower(x), '[^a-z]', '', 'g')" if fold
             else "lower(regexp_replace(x, '[^a-z]', '', 'g'))")
    return (f"list_has_any(list_transform({column}, lambda x: {inner}), "
            "['bluebolt', 'redring', 'hotrod'])")


@register("search_filtered", "O-FLT-2 O-FLT-3 O-FLT-6", f"""WITH {OFFERS_SQL}
SELECT {PAGE_COLUMNS_SQL} FROM offers WHERE NOT rejected
  AND source IN ('linkedin', 'apec') AND location_mode IN ('remote', 'on-site')
  AND ({_overlap_sql('primary_technologies', False)} OR {_overlap_sql('secondary_technologies', False)})
ORDER BY offers.score DESC NULLS LAST, id LIMIT 25""")
def search_filtered(spark, folder):
    params = search.SearchParams(
        sources=["linkedin", "apec"], location_modes=["REMOTE", "ON_SITE"],
        technologies=TECH_TERMS, sort_by="score")
    return page_columns(search.search_page(offers_view(spark, folder), params))


@register("search_totals", "O-AGG-3", f"""WITH {OFFERS_SQL}
SELECT count(*) AS total_count, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages FROM offers
WHERE NOT rejected AND location_mode IN ('remote', 'hybrid')
  AND ({_overlap_sql('primary_technologies', False)} OR {_overlap_sql('secondary_technologies', False)})""")
def search_totals(spark, folder):
    params = search.SearchParams(
        per_page=10, location_modes=["remote", "hybrid"], technologies=TECH_TERMS)
    return search.search_totals(offers_view(spark, folder), params)


@register("search_label_cases", "O-FN-4 O-SET-4", f"""WITH {OFFERS_SQL}
SELECT id,
  {_overlap_sql('primary_technologies', False)} OR {_overlap_sql('secondary_technologies', False)} AS as_stored,
  {_overlap_sql('primary_technologies', True)} OR {_overlap_sql('secondary_technologies', True)} AS case_folded
FROM offers""")
def search_label_cases(spark, folder):
    return offers_view(spark, folder).select(
        "id",
        search.uses_any_technology(TECH_TERMS).alias("as_stored"),
        search.uses_any_technology(TECH_TERMS, fold_case_first=True).alias("case_folded"))


@register("search_seen_range", "O-FLT-4 O-FLT-5", f"""WITH {BASE_SQL}
SELECT id, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM base
WHERE NOT rejected AND first_seen_at >= TIMESTAMP '1997-01-01' AND first_seen_at <= TIMESTAMP '1999-06-30'
  AND last_seen_at >= TIMESTAMP '1997-02-01' AND last_seen_at <= TIMESTAMP '1999-06-15'""")
def search_seen_range(spark, folder):
    params = search.SearchParams(
        first_seen_after=dt.datetime(1997, 1, 1), first_seen_before=dt.datetime(1999, 6, 30),
        last_seen_after=dt.datetime(1997, 2, 1), last_seen_before=dt.datetime(1999, 6, 15))
    rows = offers_base(spark, folder).drop("first_seen_at")
    return search.matching(rows, params).select(
        "id", ts_text(F.col("first_seen_at")).alias("first_seen_at"))


@register("search_by_company", "O-SRT-1", f"""WITH {BASE_SQL}, {PLACES_SQL}
SELECT {PAGE_COLUMNS_SQL} FROM places WHERE NOT rejected
ORDER BY company ASC NULLS LAST, id LIMIT 40 OFFSET 80""")
def search_by_company(spark, folder):
    rows = with_places(offers_base(spark, folder), spark, folder)
    params = search.SearchParams(
        page=3, per_page=40, sort_by="company", sort_direction="ASC")
    return page_columns(search.search_page(rows, params))


@register("search_by_title", "O-SRT-1", f"""WITH {BASE_SQL}
SELECT id, title FROM base WHERE NOT rejected
ORDER BY title DESC NULLS LAST, id LIMIT 30 OFFSET (
  SELECT greatest(count(*) - 40, 0) // 30 * 30 FROM base WHERE NOT rejected AND title IS NOT NULL)""")
def search_by_title(spark, folder):
    rows = offers_base(spark, folder)
    # the page on which the titled offers end and those without a title begin
    titled = search.visible(rows).where(F.col("title").isNotNull()).count()
    params = search.SearchParams(
        page=max(titled - 40, 0) // 30 + 1, per_page=30, sort_by="title")
    return search.search_page(rows, params).select("id", "title")


@register("search_toggled", "O-SRT-4", f"""WITH {BASE_SQL}
SELECT 'same column' AS click, id FROM (SELECT id FROM base WHERE NOT rejected ORDER BY score ASC NULLS LAST, id LIMIT 25)
UNION ALL SELECT 'again', id FROM (SELECT id FROM base WHERE NOT rejected ORDER BY score DESC NULLS LAST, id LIMIT 25)
UNION ALL SELECT 'other column', id FROM (SELECT id FROM base WHERE NOT rejected ORDER BY title DESC NULLS LAST, id LIMIT 25)""")
def search_toggled(spark, folder):
    """Pages after clicks on column heads, from the default order by falling score."""
    rows, order, pages = offers_base(spark, folder), ("score", "desc"), []
    for click, column in (("same column", "score"), ("again", "score"), ("other column", "title")):
        order = search.toggle_sort(*order, column)
        params = search.SearchParams(sort_by=order[0], sort_direction=order[1])
        pages.append(search.search_page(rows, params).select(F.lit(click).alias("click"), "id"))
    return pages[0].union(pages[1]).union(pages[2])


@register("search_deep_page", "O-SRT-2", f"""WITH {BASE_SQL}
SELECT id, CAST(score AS BIGINT) AS score FROM base WHERE NOT rejected
ORDER BY score DESC NULLS LAST, id LIMIT 50 OFFSET (
  SELECT greatest(count(*) // 50 - 3, 0) * 50 FROM base WHERE NOT rejected)""")
def search_deep_page(spark, folder):
    rows = search.visible(offers_base(spark, folder))
    offset = max(rows.count() // 50 - 3, 0) * 50
    params = search.SearchParams(per_page=50, sort_by="score")
    return search.page_at(rows, params, offset, top_rows=1000).select(
        "id", F.col("score").cast("long").alias("score"))


_PRESETS = {
    "today": ("TIMESTAMP '2001-08-15 00:00:00'", "TIMESTAMP '2001-08-15 12:00:00'"),
    "yesterday": ("TIMESTAMP '2001-08-14 00:00:00'", "TIMESTAMP '2001-08-14 23:59:59.999'"),
    "last_7_days": ("TIMESTAMP '2001-08-09 00:00:00'", "TIMESTAMP '2001-08-15 12:00:00'"),
    "last_30_days": ("TIMESTAMP '2001-07-17 00:00:00'", "TIMESTAMP '2001-08-15 12:00:00'"),
}
# the offers are moved so that many of them fall into the presets' month
_MOVED_SQL = "TIMESTAMP '2001-07-10' + to_days(CAST(id % 40 AS INTEGER)) + INTERVAL 10 HOUR"


@register("search_presets", "O-FLT-9 O-FLT-10 O-FLT-11", f"""WITH {BASE_SQL},
moved AS (SELECT id, source, {_MOVED_SQL} AS seen FROM base WHERE NOT rejected)
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS preset, source, count(*) AS offers FROM moved "
    f"WHERE seen >= {low} AND seen <= {high} GROUP BY source"
    for name, (low, high) in _PRESETS.items()))
def search_presets(spark, folder):
    moved = offers_base(spark, folder).withColumn(
        "last_seen_at",
        F.lit("2001-07-10 10:00:00").cast("timestamp")
        + F.make_interval(days=(F.col("id") % 40).cast("int")))
    ranges = {p: preset_range(p, NOW) for p in _PRESETS}
    presets = [
        F.when(F.col("last_seen_at").between(F.lit(low), F.lit(high)), F.lit(p))
        for p, (low, high) in ranges.items()
    ]
    request = {"seenField": "last_seen_at", "datePreset": "last_30_days", "sortBy": "nonsense"}
    params = search.params_from_request(request, NOW)
    # every preset lies inside the widest one, so one filtered pass serves all
    return (
        search.matching(moved, params)
        .select("source", F.explode(F.array_compact(F.array(*presets))).alias("preset"))
        .groupBy("preset", "source").agg(F.count("*").alias("offers"))
    )


# --- metrics -----------------------------------------------------------------

_TOTALS_SQL = """count(*) AS total, count(*) FILTER (WHERE id % 2 <> 0) AS fetched,
  count(*) FILTER (WHERE id % 5 <> 0) AS enriched, count(*) FILTER (WHERE id % 7 <> 0) AS scored,
  round(avg(score), 1) AS average_score"""


@register("dashboard_totals", "O-AGG-1 O-FLT-7 O-FLT-8",
          f"WITH {BASE_SQL} SELECT {_TOTALS_SQL} FROM base")
def dashboard_totals(spark, folder):
    return metrics.dashboard_totals(offers_base(spark, folder))


@register("top_sources", "O-AGG-2 O-SRT-3", f"""WITH {BASE_SQL}
SELECT source, count(*) AS count FROM base GROUP BY source ORDER BY count(*) DESC, source LIMIT 5""")
def top_sources(spark, folder):
    return metrics.top_sources(offers_base(spark, folder))


@register("dashboard", "O-AGG-1 O-AGG-2", f"""WITH {BASE_SQL},
top AS (SELECT source, count(*) AS n FROM base GROUP BY source ORDER BY n DESC, source LIMIT 5)
SELECT {_TOTALS_SQL}, (SELECT string_agg(source || '=' || n, ',' ORDER BY n DESC, source) FROM top)
  AS top_sources FROM base""")
def dashboard(spark, folder):
    return metrics.dashboard(offers_base(spark, folder)).withColumn(
        "top_sources",
        F.array_join(F.transform(
            "top_sources",
            lambda t: F.concat(t["source"], F.lit("="), t["count"].cast("string"))), ","))


@register("rescore_count", "O-AGG-6", "SELECT count(*) AS enqueued_count FROM orders")
def rescore_count(spark, folder):
    return score.rescore_count(offers_base(spark, folder))


# --- scoring -----------------------------------------------------------------

SCORED_SQL = f"""{OFFERS_SQL},
prepared AS (
  SELECT *, {KNOWN_SQL} AS known,
    list_transform(primary_technologies, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS op,
    list_transform(secondary_technologies, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS os,
    coalesce(location_mode, '') AS mode, lower(coalesce(city, '')) AS lcity,
    coalesce(hybrid_remote_days_min_per_week, 0) AS days FROM offers),
parts AS (
  SELECT *,
    list_filter(op, lambda x: NOT list_contains(known, x)) AS missing,
    list_filter(list_distinct(os), lambda x: list_contains(known, x)) AS matches,
    CASE mode WHEN 'remote' THEN 0 WHEN 'hybrid' THEN 1 WHEN 'on-site' THEN 2 ELSE -1 END AS rank,
    CASE mode WHEN 'hybrid' THEN contains(lcity, 'nation_1') OR contains(lcity, 'nation_2')
      WHEN 'on-site' THEN contains(lcity, 'nation_3') OR contains(lcity, 'nation_5') ELSE true END AS city_ok
  FROM prepared),
judged AS (
  SELECT *, CASE WHEN len(op) = 0 THEN 0 ELSE 100 - len(missing) * (100 // len(op)) + 3 * len(matches) END AS tech,
    CASE WHEN rank < 0 THEN 'not_in_preference' WHEN NOT city_ok THEN 'city_not_allowed'
      WHEN mode = 'hybrid' AND days < 2 THEN 'hybrid_remote_days_insufficient'
      WHEN rank > 0 THEN 'lower_preference_rank' END AS reason
  FROM parts),
scored AS (
  SELECT *, CASE WHEN reason IS NULL THEN 0 WHEN reason = 'lower_preference_rank'
    THEN rank * 20 + CASE WHEN mode = 'hybrid' THEN (5 - days) * 10 ELSE 0 END ELSE 100 END AS malus
  FROM judged),
final AS (SELECT *, greatest(0, least(100, tech - malus)) AS new_score FROM scored)"""


def scored_offers(spark, folder):
    return score.score_with(offers_view(spark, folder), score.literal_profile(PROFILE))


@register("score_offers", "O-SCR-1 O-SCR-2 O-SCR-3 O-SCR-4 O-FN-2 O-FN-20 O-JN-3",
          f"WITH {SCORED_SQL} SELECT id, CAST(new_score AS BIGINT) AS score FROM final")
def score_offers(spark, folder):
    return scored_offers(spark, folder).select(
        "id", F.col("new_score").cast("long").alias("score"))


@register("score_by_days", "O-SCR-7", f"WITH {SCORED_SQL} SELECT id, true AS monotone, CAST(5 AS BIGINT) AS tried FROM final")
def score_by_days(spark, folder):
    """Each offer as hybrid with 1 to 5 remote days: more days never score lower."""
    days = offers_view(spark, folder).withColumn("location_mode", F.lit("hybrid")).withColumn(
        "hybrid_remote_days_min_per_week", F.explode(F.array(*[F.lit(d) for d in range(1, 6)])))
    scored = score.score_with(days, score.literal_profile(PROFILE))
    tried = F.sort_array(F.collect_list(F.struct("hybrid_remote_days_min_per_week", "new_score")))
    in_order = F.transform("tried", lambda t: t["new_score"])
    return scored.groupBy("id").agg(tried.alias("tried")).select(
        "id", (F.array_sort(in_order) == in_order).alias("monotone"), F.size("tried").cast("long").alias("tried"))


@register("score_breakdown", "O-SCR-5 O-SET-1 O-SET-2", f"""WITH {SCORED_SQL}
SELECT id, CASE WHEN len(op) = 0 THEN 'offer_has_no_technologies' END AS warning,
  CASE WHEN len(op) > 0 AND len(missing) > 0 THEN array_to_string(missing, '|') END AS missing,
  CASE WHEN len(op) > 0 AND len(matches) > 0 THEN array_to_string(list_sort(matches), '|') END AS matches,
  reason, CASE WHEN reason = 'lower_preference_rank' THEN CAST(rank AS BIGINT) END AS rank,
  CASE WHEN reason = 'lower_preference_rank' THEN CAST(rank * 20 AS BIGINT) END AS malus,
  CASE WHEN reason = 'city_not_allowed' THEN lcity END AS city FROM final""")
def score_breakdown(spark, folder):
    b = "new_breakdown."
    return scored_offers(spark, folder).select(
        "id",
        F.col(b + "technology.warning").alias("warning"),
        F.array_join(b + "technology.missing_required_technologies", "|").alias("missing"),
        F.array_join(F.sort_array(b + "technology.matching_secondary_technologies"), "|")
        .alias("matches"),
        F.col(b + "location.penalty_reason").alias("reason"),
        F.col(b + "location.rank").cast("long").alias("rank"),
        F.col(b + "location.malus").cast("long").alias("malus"),
        F.col(b + "location.city").alias("city"))


@register("scored_search", "O-SCR-6 O-SRT-1 O-SRT-2", f"""WITH {SCORED_SQL}
SELECT id, title, company, source, location_mode, CAST(new_score AS BIGINT) AS score
FROM final WHERE NOT rejected ORDER BY new_score DESC NULLS LAST, id LIMIT 25""")
def scored_search(spark, folder):
    scored = scored_offers(spark, folder).withColumn("score", F.col("new_score"))
    found = search.search_page(scored, search.SearchParams(sort_by="score"))
    return found.select(
        "id", "title", "company", "source", "location_mode",
        F.col("score").cast("long").alias("score"))


@register("rescore_gate", "O-SCR-6 O-INC-1 O-INC-2", f"""WITH {SCORED_SQL}
SELECT id, CASE WHEN id % 7 <> 0 AND step_version = 2 THEN CAST(score AS BIGINT)
    ELSE CAST(new_score AS BIGINT) END AS score,
  CAST(2 AS BIGINT) AS version,
  CASE WHEN id % 7 <> 0 AND step_version = 2 THEN step_at ELSE '2001-08-15T12:00:00Z' END AS scored_at
FROM final""")
def rescore_gate(spark, folder):
    rows = offers_view(spark, folder).withColumns({
        "score_breakdown": F.lit(None).cast(SCORE_BREAKDOWN),
        "updated_at": F.col("last_seen_at"),
    })
    done = score.score_offers(rows, PROFILE, now())
    step = F.col("steps_details")["score"]
    return done.select(
        "id", F.col("score").cast("long").alias("score"),
        step["version"].cast("long").alias("version"), step["at"].alias("scored_at"))


@register("missing_technologies", "O-JN-7", f"""WITH {OFFERS_SQL}
SELECT DISTINCT id, technology FROM (
  SELECT id, regexp_replace(lower(unnest(primary_technologies)), '[^a-z0-9]+', '', 'g') AS technology
  FROM offers) WHERE NOT list_contains({KNOWN_SQL}, technology)""")
def missing_technologies(spark, folder):
    known = PROFILE["technology"]["primary"] + PROFILE["technology"]["secondary"]
    rows = with_technologies(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")), spark, folder)
    return score.missing_technologies(rows, known)


@register("array_set_ops", "O-SET-1 O-SET-2 O-SET-3 O-SET-4", f"""WITH {OFFERS_SQL}
SELECT id,
  array_to_string(list_sort(list_filter(primary_technologies, lambda x: NOT list_contains(secondary_technologies, x))), '|') AS minus,
  array_to_string(list_sort(list_filter(primary_technologies, lambda x: list_contains(secondary_technologies, x))), '|') AS common,
  CAST(len(list_distinct(list_concat(primary_technologies, secondary_technologies))) AS BIGINT) AS together,
  list_has_any(primary_technologies, secondary_technologies) AS overlap FROM offers""")
def array_set_ops(spark, folder):
    a, b = F.col("primary_technologies"), F.col("secondary_technologies")
    return offers_view(spark, folder).select(
        "id",
        F.array_join(F.sort_array(arrays.difference(a, b)), "|").alias("minus"),
        F.array_join(F.sort_array(arrays.intersection(a, b)), "|").alias("common"),
        F.size(arrays.union_distinct(a, b)).cast("long").alias("together"),
        arrays.overlaps(a, b).alias("overlap"))
