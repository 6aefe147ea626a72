"""Registered queries: text functions, relevance, enrichment, gates, quality,
reshapes, job status."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.fixed_values import CONTRACT_RULES, MODE_RULES
from offerloom.functions import dates, places, rules, salary, text
from offerloom.functions.arrays import array_to_json
from offerloom.operators import enrich, incremental, metrics, migrate, quality
from offerloom.operators.relevance import is_relevant, reject, relevance_flag
from offerloom.plans.registered import CATALOG, register
from offerloom.plans.views import (
    BASE_SQL,
    JOB_CLASS_SQL,
    NOW_TEXT,
    OFFERS_SQL,
    job_runs_view,
    now,
    offers_base,
    offers_view,
    pick,
    sql_pick,
    sql_rules,
    sql_text,
    table,
    ts_text,
)
from offerloom.sources.partitions import spread
from offerloom.sources.profile import parse_profiles
from offerloom.streaming.throttle import CHUNK_MS, throttled

SOURCES = ["linkedin", "hellowork", "apec", "cadremploi", "france_travail", "wttj"]


def parts(spark, folder, texts):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(key.alias("id"), pick(texts, key).alias("raw"))


def parts_sql(texts, extra=""):
    return f"rows AS (SELECT p_partkey AS id, {sql_pick(texts, 'p_partkey')} AS raw{extra} FROM part)"


def per_source(rows, build):
    return rows.select("id", *[build(s).alias(s) for s in SOURCES])


# --- rules -------------------------------------------------------------------

CONTRACT_TEXTS = [
    "CDI", "cdi", "CDD de 6 mois", "Contrat pro", "Intérim", "INTÉRIM", "Stage de fin",
    "backstage", "Apprentissage", "full_time", "Full-time", "temps plein", "Temps partiel",
    "PART_TIME", "Freelance", "Indépendant", "Profession libérale", "saisonnier", "Contractuel",
    "permanent role", "fixed term", "internship", "inconnu", "", "professionnalisation",
]


def _collapsed(expr):
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


@register("contract_types", "O-FN-6", f"""WITH {parts_sql(CONTRACT_TEXTS)}
SELECT id, {', '.join(f"{sql_rules('raw', CONTRACT_RULES[s])} AS {s}" for s in SOURCES)} FROM rows""")
def contract_types(spark, folder):
    return per_source(
        parts(spark, folder, CONTRACT_TEXTS), lambda s: rules.contract_type(s, F.col("raw")))


MODE_TEXTS = [
    "Télétravail total", "TÉLÉTRAVAIL PARTIEL", "hybride", "Full remote", "100% télétravail",
    "2 jours", "Sur site", "Présentiel", "on-site", "Total possible", "ponctuel autorisé",
    "aucun télétravail", "Poste à Lyon", "", "partial", "no_remote", "quelques jours", "remote",
    "teletravail complet", "a distance", "in office",
]


@register("location_modes", "O-FN-7", f"""WITH {parts_sql(MODE_TEXTS, ', p_size % 5 = 0 AS marked')}
SELECT id,
  {sql_rules('raw', MODE_RULES['linkedin'])} AS linkedin,
  coalesce({sql_rules('raw', MODE_RULES['hellowork'])}, CASE WHEN marked THEN 'remote' END) AS hellowork,
  {sql_rules('raw', MODE_RULES['apec'])} AS apec,
  coalesce(CASE WHEN marked THEN 'remote' END, {sql_rules('raw', MODE_RULES['cadremploi'])}) AS cadremploi,
  CASE WHEN raw = '' THEN NULL ELSE {sql_rules('raw', MODE_RULES['france_travail'], "'on-site'")} END AS france_travail,
  {sql_rules('raw', MODE_RULES['wttj'])} AS wttj FROM rows""")
def location_modes(spark, folder):
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        key.alias("id"), pick(MODE_TEXTS, key).alias("raw"),
        F.when(F.col("p_size") % 5 == 0, F.lit("TELECOMMUTE")).alias("marker"))
    return per_source(
        rows, lambda s: rules.location_mode(
            s, [F.col("raw")], F.col("marker") if s in ("cadremploi", "hellowork") else None))


@register("topcard_modes", "O-FN-7", f"""
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'on-site' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote'
  WHEN 3 THEN 'hybrid' END AS mode FROM part""")
def topcard_modes(spark, folder):
    texts = [
        "Paris, Ile-de-France, France (On-site) remote test", "Lyon HybrideTemps pleinEnregistrer",
        "Nantes, Pays de la Loire, France · 2 days ago · Remote",
        "X, France, France · 4 jours · Hybrid", "remote work is described here",
    ]
    return parts(spark, folder, texts).select(
        "id", rules.topcard_location_mode(F.col("raw")).alias("mode"))


CITY_TEXTS = ["75 - PARIS 01", "63 - Clermont-Ferrand", "Lyon - 69", "Rennes, Nantes", " Brest ",
              "971 – Baie-Mahault", "LE MANS - 072", ""]
_PREFIX = "regexp_replace(raw, '^\\d+\\s*-\\s*', '')"
_WORDS = ("array_to_string(list_transform(string_split({0}, ' '), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@register("city_clean", "O-FN-8", f"""WITH {parts_sql(CITY_TEXTS)}
SELECT id, nullif(trim(raw), '') AS linkedin,
  nullif(trim(regexp_replace(trim(raw), '\\s*-\\s*\\d{{2,3}}$', '')), '') AS hellowork,
  nullif(trim(regexp_replace(trim(raw), '\\s*-\\s*\\d{{2,3}}$', '')), '') AS apec,
  nullif(trim(regexp_replace(raw, '^\\d+\\s*[-–]\\s*', '')), '') AS cadremploi,
  nullif({_WORDS.format(f'trim({_PREFIX})')}, '') AS france_travail,
  nullif(trim(string_split(raw, ',')[1]), '') AS wttj FROM rows""")
def city_clean(spark, folder):
    return per_source(parts(spark, folder, CITY_TEXTS), lambda s: places.city(s, F.col("raw")))


PLACE_TEXTS = [
    "Menu Senior Ruby Developer Nantes, Pays de la Loire, France", "Paris, Ile-de-France, France",
    "Greater Lyon Metropolitan Region · 3 days", "nothing here", "FToulouse, Occitanie, France",
    "Lille, Nord, France puis Rennes, Bretagne, France",
]


@register("french_places", "O-FN-9", f"""WITH {parts_sql(PLACE_TEXTS)}
SELECT id, list_extract(['Nantes, Pays de la Loire, France', 'Paris, Ile-de-France, France', NULL, NULL,
    'FToulouse, Occitanie, France', 'puis Rennes, Bretagne, France'], CAST(id % 6 + 1 AS INTEGER)) AS raw_triplet,
  list_extract(['Menu Senior Ruby Developer Nantes, Pays de la Loire, France', 'Paris, Ile-de-France, France',
    'Lyon et périphérie', 'nothing here', 'Toulouse, Occitanie, France',
    'Lille, Nord, France puis Rennes, Bretagne, France'], CAST(id % 6 + 1 AS INTEGER)) AS label,
  CASE id % 6 WHEN 2 THEN 'Lyon et périphérie' END AS metro FROM rows""")
def french_places(spark, folder):
    raw = F.col("raw")
    rows = parts(spark, folder, PLACE_TEXTS)
    return rows.select(
        "id", places.french_triplet(raw).alias("raw_triplet"),
        places.location_label(raw).alias("label"),
        F.when(F.col("id") % 6 == 2, places.topcard_city(
            F.lit(""), F.array(raw))).alias("metro"))


# --- salary ------------------------------------------------------------------

SALARY_TEXTS = [
    "Salary: EUR 60k - EUR 80k", "45 KEUR - 60 KEUR", "35 000 - 40 000 € / an", "50 - 60 k€ brut",
    "50K à 80K €", "Salaire selon profil", "A négocier", "Non spécifié", "40 KEUR", "60K €",
    "2 500 $ par mois", "compensation 55,5k to 70k GBP", "rien", "",
]


def _money_sql(expr):
    return f"CAST(nullif(regexp_replace({expr}, '\\D', '', 'g'), '') AS BIGINT)"


def _g(pattern, i):
    return f"regexp_extract(raw, {sql_text(pattern)}, {i})"


_CE_R, _CE_S = r"(?i)(\d[\d\s]*)\s*KEUR\s*[-–]\s*(\d[\d\s]*)\s*KEUR", r"(?i)(\d[\d\s]*)\s*KEUR"
_HW_R, _HW_S = r"(\d[\d\s]+)\s*[-–]\s*(\d[\d\s]+)\s*[€$£]", r"(\d[\d\s]+)\s*[€$£]"
_WJ_R, _WJ_S = r"(?i)(\d+[\sKk]*)[\sà\-]+(\d+[\sKk]*)", r"(?i)(\d+[\sKk]*)"
_CE_OK = "NOT regexp_matches(raw, '(?i)selon.*profil|non.*spécifié')"
_WJ_OK = "NOT regexp_matches(raw, '(?i)non spécifié')"


def _wj(expr):
    return (f"CAST(nullif(regexp_replace({expr}, '[\\sKk]', '', 'g'), '') AS BIGINT)"
            f" * CASE WHEN regexp_matches({expr}, '[Kk]') THEN 1000 ELSE 1 END")


def _ap(i):
    n = f"list_extract(regexp_extract_all(raw, '\\d+(?:[.,]\\d+)?'), {i})"
    v = f"CAST(replace({n}, ',', '.') AS DOUBLE)"
    return (f"CASE WHEN raw = '' OR regexp_matches(raw, '(?i)n[ée]gocier') OR NOT coalesce({v} > 0, false) THEN NULL "
            f"WHEN regexp_matches(raw, '(?i)k\\s*€|k€|\\bk\\b') AND {v} < 1000 THEN CAST(trunc({v} * 1000) AS BIGINT) "
            f"ELSE CAST(trunc({v}) AS BIGINT) END")


@register("salary_texts", "O-FN-11 O-FN-13", f"""WITH {parts_sql(SALARY_TEXTS)}
SELECT id,
  CASE id % 14 WHEN 0 THEN 6000000 WHEN 11 THEN NULL END AS linkedin_low,
  CASE id % 14 WHEN 0 THEN 8000000 END AS linkedin_high,
  CASE WHEN {_CE_OK} THEN coalesce({_money_sql(_g(_CE_R, 1))}, {_money_sql(_g(_CE_S, 1))}) * 1000 END AS cadremploi_low,
  CASE WHEN {_CE_OK} THEN {_money_sql(_g(_CE_R, 2))} * 1000 END AS cadremploi_high,
  coalesce({_money_sql(_g(_HW_R, 1))}, {_money_sql(_g(_HW_S, 1))}) AS hellowork_low,
  {_money_sql(_g(_HW_R, 2))} AS hellowork_high,
  {_ap(1)} AS apec_low, {_ap(2)} AS apec_high,
  CASE WHEN {_WJ_OK} THEN coalesce({_wj(_g(_WJ_R, 1))}, {_wj(_g(_WJ_S, 1))}) END AS wttj_low,
  CASE WHEN {_WJ_OK} THEN {_wj(_g(_WJ_R, 2))} END AS wttj_high,
  CASE WHEN regexp_matches(raw, '(?i)€|eur') THEN 'EUR' WHEN contains(raw, '$') THEN 'USD'
    WHEN regexp_matches(raw, '(?i)£|gbp') THEN 'GBP' END AS text_currency
FROM rows""")
def salary_texts(spark, folder):
    rows = parts(spark, folder, SALARY_TEXTS)
    for name, parse in salary.TEXT_PARSERS.items():
        rows = rows.withColumn(name, parse(F.col("raw")))
    return rows.select("id", *[
        F.col(f"{s}.{side}").alias(f"{s}_{side}")
        for s in salary.TEXT_PARSERS for side in ("low", "high")
    ], salary.currency_in_text(F.col("raw")).alias("text_currency"))


CURRENCIES = ["€", "$", "£", "eur", " USD ", "gbp", "CHF", "", "Euro"]


@register("currencies", "O-FN-13", f"""WITH {parts_sql(CURRENCIES)}
SELECT id, CASE trim(raw) WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' ELSE
  CASE WHEN upper(trim(raw)) IN ('EUR', 'USD', 'GBP') THEN upper(trim(raw)) END END AS code FROM rows""")
def currencies(spark, folder):
    return parts(spark, folder, CURRENCIES).select(
        "id", salary.currency_code(F.col("raw")).alias("code"))


@register("salary_structured", "O-FN-10", """
SELECT p_partkey AS id,
  CASE WHEN p_retailprice > 0 THEN CAST(trunc(p_retailprice * CASE p_partkey % 3 WHEN 1 THEN 12 ELSE 1 END) AS BIGINT) END AS yearly,
  CASE p_partkey % 3 WHEN 0 THEN CAST(trunc(p_retailprice) AS BIGINT) WHEN 1 THEN CAST(trunc(p_retailprice) AS BIGINT) * 12 END AS microdata,
  CAST(trunc(round(p_retailprice * 100)) AS BIGINT) AS minor FROM part""")
def salary_structured(spark, folder):
    value = F.col("p_retailprice").cast("string")
    unit = pick(["YEAR", "MONTH", "HOUR"], F.col("p_partkey"))
    none = F.lit(None).cast("string")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        salary.yearly(value, unit).alias("yearly"),
        salary.microdata(value, value, unit, none)["low"].alias("microdata"),
        salary.minor_amount(value).alias("minor"))


@register("salary_whole_units", "O-FN-12", f"""WITH {BASE_SQL}
SELECT id, CASE WHEN source = 'linkedin' THEN id * 100 // 100 ELSE id END AS amount FROM base""")
def salary_whole_units(spark, folder):
    rows = offers_base(spark, folder)
    stored = F.when(F.col("source") == "linkedin", F.col("id") * 100).otherwise(F.col("id"))
    return rows.select("id", salary.whole_units(F.col("source"), stored).alias("amount"))


# --- dates -------------------------------------------------------------------

AGO_TEXTS = ["{n} days ago", "Posted {n} hours ago", "il y a {n} jours", "{n} weeks ago",
             "Reposted {n} months ago", "today", "aujourd'hui", "il y a {n} minutes", "soon", ""]


def _ago_rows(spark, folder):
    key = F.col("o_orderkey")
    phrase = F.replace(pick(AGO_TEXTS, key), F.lit("{n}"), (key % 23 + 1).cast("string"))
    return table(spark, folder, "orders").select(
        key.alias("id"), phrase.alias("raw"), F.col("o_orderdate").cast("timestamp").alias("at"))


@register("relative_dates", "O-FN-15", """WITH rows AS (
  SELECT o_orderkey AS id, o_orderkey % 10 AS kind, CAST(o_orderkey % 23 + 1 AS INTEGER) AS n, o_orderdate AS seen FROM orders)
SELECT id, strftime(CASE kind WHEN 0 THEN seen - to_days(n) WHEN 1 THEN seen - to_hours(n) WHEN 2 THEN seen - to_days(n)
    WHEN 3 THEN seen - to_days(n * 7) WHEN 4 THEN seen - to_months(n) WHEN 5 THEN seen WHEN 6 THEN seen
    WHEN 7 THEN seen - to_minutes(n) END, '%Y-%m-%d %H:%M:%S') AS posted_at,
  strftime(CASE kind WHEN 0 THEN seen - to_days(n) WHEN 1 THEN seen - to_hours(n) WHEN 2 THEN seen - to_days(n)
    WHEN 3 THEN seen - to_days(n * 7) WHEN 4 THEN seen - to_months(n)
    WHEN 7 THEN seen - to_minutes(n) END, '%Y-%m-%d %H:%M:%S') AS in_page,
  strftime(CASE kind WHEN 2 THEN seen - to_days(n) END, '%Y-%m-%d %H:%M:%S') AS cadremploi FROM rows""")
def relative_dates(spark, folder):
    raw, at = F.col("raw"), F.col("at")
    return _ago_rows(spark, folder).select(
        "id", ts_text(dates.ago(raw, at)).alias("posted_at"),
        ts_text(dates.ago_in_page(raw, at)).alias("in_page"),
        ts_text(dates.cadremploi_date(raw, at)).alias("cadremploi"))


@register("absolute_dates", "O-FN-14", """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS iso,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS french,
  strftime(o_orderdate + to_hours(14), '%Y-%m-%d %H:%M:%S') AS millis FROM orders""")
def absolute_dates(spark, folder):
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = F.date_format(at, "yyyy-MM-dd")
    raw = (
        F.when(key % 4 == 0, day).when(key % 4 == 1, F.concat(day, F.lit("T00:00:00Z")))
        .when(key % 4 == 2, F.concat(day, F.lit("T02:00:00+02:00"))).otherwise("not a date"))
    script = F.concat(
        F.lit('{"listedAt" : '),
        F.unix_millis(at + F.expr("INTERVAL 14 HOURS")).cast("string"), F.lit("}"))
    padded = F.regexp_replace(script, r": (\d{12})\}", r": 0$1}")
    return table(spark, folder, "orders").select(
        key.alias("id"), ts_text(dates.parse_instant(raw)).alias("iso"),
        ts_text(dates.day_month_year(F.concat(
            F.lit("Publiée le "), F.date_format(at, "dd/MM/yyyy")))).alias("french"),
        ts_text(dates.listed_at(padded)).alias("millis"))


# --- text --------------------------------------------------------------------

@register("whitespace", "O-FN-1 O-FN-16", f"""
SELECT doc_id, {_collapsed("translate(text, chr(160) || chr(8239), '  ')")} AS linkedin,
  {_collapsed("translate(text, chr(160), ' ')")} AS hellowork,
  nullif(trim(regexp_replace(substr(text, 1, 0), '\\s', '')), '') AS blank,
  coalesce(nullif(trim(lang), ''), source) AS first FROM documents""")
def whitespace(spark, folder):
    raw = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", text.collapse_for("linkedin", raw).alias("linkedin"),
        text.collapse_for("hellowork", raw).alias("hellowork"),
        text.collapse_for("apec", F.lit("  \t\n")).alias("blank"),
        text.first_non_blank(F.lit(" \n"), F.col("lang"), F.col("source")).alias("first"))


LABELS = [["C++ ", "Node.js", "c++"], [" PostgreSQL", "", "Vue 3", "PostgreSQL"], [], ["C#", " C# "]]


@register("technology_labels", "O-FN-2 O-FN-3 O-FN-5", f"""WITH rows AS (
  SELECT p_partkey AS id, list_append(list_extract([['C++ ', 'Node.js', 'c++'], [' PostgreSQL', '', 'Vue 3', 'PostgreSQL'],
    CAST([] AS VARCHAR[]), ['C#', ' C# ']], CAST(p_partkey % 4 + 1 AS INTEGER)), p_name) AS labels FROM part)
SELECT id,
  array_to_string(list_transform(labels, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), '|') AS scoring,
  array_to_string(list_transform(labels, lambda x: lower(regexp_replace(x, '[^a-zA-Z]', '', 'g'))), '|') AS enriched,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(labels, lambda x: trim(x)), lambda x: x <> ''))), '|') AS cased
FROM rows""")
def technology_labels(spark, folder):
    lists = F.array(*[F.array(*[F.lit(x) for x in row]).cast("array<string>") for row in LABELS])
    labels = F.array_append(
        F.element_at(lists, (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.array_join(F.transform(labels, text.scoring_label), "|").alias("scoring"),
        F.array_join(F.transform(labels, text.enriched_label), "|").alias("enriched"),
        F.array_join(F.sort_array(text.cased_labels(labels)), "|").alias("cased"))


FRAGMENTS = ["<p>A &amp; B</p>", "<ul><li>x</li> <li>y&nbsp;z</li></ul>", "plain &lt;text&gt;", "<br>", ""]


@register("plain_texts", "O-ANL-TXT", f"""WITH {parts_sql(FRAGMENTS)}
SELECT id, list_extract(['A & B', 'x y z', 'plain <text>', '', ''], CAST(id % 5 + 1 AS INTEGER)) AS plain FROM rows""")
def plain_texts(spark, folder):
    return parts(spark, folder, FRAGMENTS).select(
        "id", F.translate(text.plain_text(F.col("raw")), text.NBSP, " ").alias("plain"))


# --- relevance ---------------------------------------------------------------

KEYWORD_SETS = [["the", "de la"], ["C#", ".net", "node.js"], ["***", "  "], ["und", "que los"],
                ["Thanks Re", "xyzzy"], ["of the", "C++"]]
# aliases apply before letters are kept: "c#" normalises to "csharp", ".net" to "dotnet"
_KW_SQL = ("list_extract([['the', 'de la'], ['csharp', 'dotnet', 'nodejs'], CAST([] AS VARCHAR[]), "
           "['und', 'que los'], ['thanks re', 'xyzzy'], ['of the', 'cpp']], CAST(doc_id % 6 + 1 AS INTEGER))")


def _relevance_sql():
    t = "text"
    for pattern, alias in ((r"(?i)c\+\+", "cpp"), ("(?i)c#", "csharp"), (r"(?i)\.net", "dotnet"),
                           (r"(?i)node\.js", "nodejs")):
        t = f"regexp_replace({t}, '{pattern}', ' {alias} ', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@register("relevance_flag", "O-REL-1 O-REL-2 O-REL-3", f"""WITH rows AS (
  SELECT doc_id, {_relevance_sql()} AS words, {_KW_SQL} AS keywords FROM documents)
SELECT doc_id, len(keywords) = 0 OR (words <> '' AND len(list_filter(keywords,
  lambda k: contains(' ' || words || ' ', ' ' || k || ' '))) > 0) AS relevant FROM rows""")
def relevance(spark, folder):
    sets = F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in KEYWORD_SETS])
    rows = table(spark, folder, "documents").select(
        "doc_id", "text",
        F.element_at(sets, (F.col("doc_id") % 6 + 1).cast("int")).alias("keywords"))
    return relevance_flag(rows, F.col("text"), F.col("keywords")).select("doc_id", "relevant")


@register("reject_rule", "O-REL-4", f"""WITH rows AS (
  SELECT page_id, lower(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|</?[a-zA-Z!][^>]*>', '', 'g'), '&#?\\w+;', ' ', 'g')) AS t
  FROM pages),
words AS (SELECT page_id, ' ' || trim(regexp_replace(regexp_replace(t, '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS w FROM rows)
SELECT page_id, page_id % 10 = 0 OR (page_id % 3 <> 0 AND NOT contains(w, CASE page_id % 3 WHEN 1 THEN ' the ' ELSE ' les ' END)) AS rejected
FROM words""")
def reject_rule(spark, folder):
    from offerloom.operators.relevance import page_words

    key = F.col("page_id")
    keywords = (
        F.when(key % 3 == 1, F.array(F.lit("The"))).when(key % 3 == 2, F.array(F.lit("les")))
        .otherwise(F.array().cast("array<string>")))
    rows = table(spark, folder, "pages").select(
        "page_id", keywords.alias("keywords"), page_words(F.col("html")).alias("words"))
    return rows.select("page_id", reject(
        key % 10 == 0, F.col("keywords"), is_relevant(F.col("keywords"), F.col("words")),
    ).alias("rejected"))


# --- enrichment --------------------------------------------------------------

def offers_with_text(spark, folder):
    key = F.col("id")
    return offers_base(spark, folder).withColumns({
        "company": F.when(key % 5 != 0, F.concat(F.lit("Company "), key.cast("string"))),
        "employment_type": F.when(key % 2 == 0, "PERMANENT"),
        "salary_min_minor": F.when(key % 3 == 0, key),
        "salary_max_minor": F.when(key % 4 != 3, key + 10),
        "description_html": F.when(
            key % 7 != 0, F.concat(F.lit("<p>Job &amp; team</p>\n <p>"), key.cast("string"), F.lit("</p>"))),
    })


_DESC = "CASE WHEN id % 7 <> 0 THEN 'Job & team ' || id ELSE '' END"


@register("prompt_text", "O-ENR-1", f"""WITH {BASE_SQL}, t AS (SELECT *,
  'Job title: ' || coalesce(title, 'unknown') || chr(10) || 'Company: ' || CASE WHEN id % 5 <> 0 THEN 'Company ' || id ELSE 'unknown' END AS head,
  chr(10) || 'Location mode: ' || coalesce(location_mode, 'unknown') AS mode_line,
  CASE WHEN id % 2 = 0 THEN 'PERMANENT' ELSE 'unknown' END AS kind,
  concat_ws('-', CASE WHEN id % 3 = 0 THEN id END, CASE WHEN id % 4 <> 3 THEN id + 10 END) AS pay FROM base)
SELECT url_hash, head || CASE source
    WHEN 'linkedin' THEN chr(10) || chr(10) || 'Top card metadata:' || chr(10)
    WHEN 'france_travail' THEN mode_line || chr(10) || 'Contract type: ' || kind || chr(10) || 'Salary: '
      || CASE WHEN pay = '' THEN 'unknown' ELSE pay END
    ELSE mode_line || chr(10) || 'Employment type: ' || kind END
  || chr(10) || chr(10) || 'Job description text:' || chr(10) || {_DESC} || chr(10) AS prompt FROM t""")
def prompt_text(spark, folder):
    return enrich.prompts(offers_with_text(spark, folder))


@register("generated_responses", "O-UDF-2", f"""WITH asked AS ({CATALOG["prompt_text"].sql})
SELECT url_hash, '{{"chars": ' || length(prompt) || ', "first": "Job title"}}' AS payload FROM asked""")
def generated_responses(spark, folder):
    """Responses by a caller's own generator, which tells each prompt's length and how it begins."""
    def generator(prompts):
        return prompts.map(lambda p: f'{{"chars": {len(p)}, "first": "{p[:9]}"}}')

    return enrich.generate_responses(prompt_text(spark, folder), generator)


PAYLOADS = [
    '{"location_mode":"hybrid","city":"Lyon","hybrid_remote_days_min_per_week":3,'
    '"primary_technologies":["Ruby on Rails"," C++ ","C++"],"secondary_technologies":null,'
    '"offer_language":"fr","normalized_seniority":"senior","english_level_required":null}',
    '{"hybrid_remote_days_min_per_week":2,"primary_technologies":[],"secondary_technologies":["Go 1.2"],'
    '"offer_language":"en","normalized_seniority":null,"english_level_required":"basic"}',
    '{"hybrid_remote_days_min_per_week":7,"primary_technologies":"x","secondary_technologies":[1],'
    '"offer_language":"de","normalized_seniority":"boss","extra":1}',
    "not json",
]


def responses(spark, folder):
    payload = F.when(F.col("id") % 9 != 0, pick(PAYLOADS, F.col("id")))
    return offers_base(spark, folder).select("url_hash", "source", payload.alias("payload"))


_VIOLATION_SQL = """WITH {base}, r AS (SELECT url_hash, source = 'linkedin' AS li, CASE WHEN id % 9 = 0 THEN 3 ELSE id % 4 END AS kind FROM base),
m AS (
  SELECT url_hash, unnest(CASE kind
    WHEN 0 THEN CASE WHEN li THEN CAST([] AS VARCHAR[]) ELSE ['unexpected location_mode', 'unexpected city'] END
    WHEN 1 THEN CASE WHEN li THEN ['missing location_mode', 'missing city'] ELSE CAST([] AS VARCHAR[]) END
    WHEN 2 THEN list_concat(CASE WHEN li THEN ['missing location_mode', 'missing city'] ELSE CAST([] AS VARCHAR[]) END,
      ['missing english_level_required', 'unexpected extra', 'invalid hybrid_remote_days_min_per_week',
       'invalid normalized_seniority', 'invalid offer_language', 'invalid primary_technologies', 'invalid secondary_technologies'])
    ELSE ['not an object'] END) AS message FROM r)
SELECT url_hash, message FROM m"""


@register("response_violations", "O-ENR-2", _VIOLATION_SQL.replace("{base}", BASE_SQL))
def response_violations(spark, folder):
    return enrich.response_violations(responses(spark, folder))


@register("response_apply", "O-ENR-3 O-ENR-4 O-JN-4 O-PRJ-5 O-INC-2", f"""WITH {BASE_SQL}, t AS (SELECT *,
    id % 4 AS kind, source = 'linkedin' AS li,
    id % 9 <> 0 AND NOT rejected AND (id % 5 = 0 OR step_version <> 1) AS run FROM base)
SELECT id, CASE WHEN run AND li THEN CASE WHEN kind = 0 THEN 'hybrid' END ELSE location_mode END AS location_mode,
  CASE WHEN run AND li AND kind = 0 THEN 'Lyon' END AS city,
  CASE WHEN run THEN CASE WHEN kind > 2 THEN NULL
      WHEN CASE WHEN li THEN CASE WHEN kind = 0 THEN 'hybrid' END ELSE location_mode END = 'hybrid'
      THEN CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 7 END END
    ELSE hybrid_remote_days_min_per_week END AS days,
  CASE WHEN run AND kind = 0 THEN CASE WHEN li THEN 'Ruby on Rails|C++' ELSE 'rubyonrails|c|c' END
    WHEN run THEN '' ELSE 'old' END AS primary_technologies,
  CASE WHEN run THEN CASE kind WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN 'de' END END AS offer_language,
  CASE WHEN run THEN '2001-08-15T12:00:00Z' WHEN id % 5 <> 0 THEN step_at END AS enriched_at FROM t""")
def response_apply(spark, folder):
    old = F.array(F.lit("old"))
    none = F.lit(None).cast("string")
    rows = offers_base(spark, folder).withColumns({
        "city": none, "offer_language": none, "normalized_seniority": none,
        "english_level_required": none, "primary_technologies": old, "secondary_technologies": old})
    done = enrich.enrich_offers(rows, responses(spark, folder), now())
    return done.select(
        "id", "location_mode", "city",
        F.col("hybrid_remote_days_min_per_week").cast("long").alias("days"),
        F.array_join("primary_technologies", "|").alias("primary_technologies"),
        "offer_language", F.col("steps_details")["enrich"]["at"].alias("enriched_at"))


@register("response_apply_strict", "O-ENR-3", f"""WITH {BASE_SQL}, t AS (SELECT *,
    id % 4 AS kind, source = 'linkedin' AS li,
    id % 9 <> 0 AND NOT rejected AND (id % 5 = 0 OR step_version <> 1) AS run FROM base)
SELECT id, CASE WHEN run THEN CASE WHEN li AND kind = 0 THEN 3 END ELSE hybrid_remote_days_min_per_week END AS days FROM t""")
def response_apply_strict(spark, folder):
    """Remote days where only LinkedIn's mode, which comes with the response, is known to the step."""
    done = enrich.enrich_offers(
        offers_base(spark, folder).withColumns({
            "city": F.lit(None).cast("string"), "offer_language": F.lit(None).cast("string"),
            "normalized_seniority": F.lit(None).cast("string"), "english_level_required": F.lit(None).cast("string"),
            "primary_technologies": F.array().cast("array<string>"), "secondary_technologies": F.array().cast("array<string>")}),
        responses(spark, folder), now(), strict_reference=True)
    return done.select("id", F.col("hybrid_remote_days_min_per_week").cast("long").alias("days"))


# --- gates -------------------------------------------------------------------

@register("version_gate", "O-INC-1 O-INC-3 O-INC-4", f"""WITH {BASE_SQL}
SELECT id, CASE WHEN id % 13 = 0 THEN true WHEN id % 3 = 0 THEN true ELSE step_version <>
    CASE source WHEN 'linkedin' THEN 3 WHEN 'hellowork' THEN 2 ELSE 1 END END AS analyze_due,
  id % 5 = 0 OR step_version <> 1 AS enrich_due FROM base""")
def version_gate(spark, folder):
    rows = offers_base(spark, folder)
    steps, source = F.col("steps_details"), F.col("source")
    return rows.select(
        "id",
        incremental.needs_run(
            steps, "analyze", incremental.step_version(source, "analyze"), F.col("id") % 13 == 0
        ).alias("analyze_due"),
        incremental.needs_run(
            steps, "enrich", incremental.step_version(source, "enrich")).alias("enrich_due"))


@register("step_stamp", "O-INC-2 O-SET-5", f"""WITH {BASE_SQL}
SELECT id, '2001-08-15T12:00:00Z' AS fetched_at, CAST(9 AS BIGINT) AS fetch_version,
  CAST(2 + CAST(id % 3 <> 0 AS INTEGER) + CAST(id % 5 <> 0 AS INTEGER) + CAST(id % 7 <> 0 AS INTEGER) AS BIGINT) AS steps
FROM base""")
def step_stamp(spark, folder):
    rows = offers_base(spark, folder).withColumn(
        "steps_details", incremental.stamp(F.col("steps_details"), "fetch", now(), F.lit(9)))
    step = F.col("steps_details")["fetch"]
    return rows.select(
        "id", step["at"].alias("fetched_at"), step["version"].cast("long").alias("fetch_version"),
        F.size("steps_details").cast("long").alias("steps"))


# --- quality -----------------------------------------------------------------

@register("dq_violations", "O-DQ-1 O-DQ-3 O-DQ-4", f"""WITH {BASE_SQL}, broken AS (SELECT id,
    CASE WHEN id % 21 <> 0 THEN source ELSE ' ' END AS source,
    CASE WHEN id % 22 <> 0 THEN last_seen_at END AS last_seen_at,
    CASE WHEN id % 8 = 0 THEN 6 ELSE hybrid_remote_days_min_per_week END AS days, id % 150 AS score,
    id % 30 AS repeats, CASE WHEN id % 19 = 0 THEN 'office' ELSE location_mode END AS location_mode FROM base)
SELECT id, 'source' AS field, 'can''t be blank' AS message FROM broken WHERE trim(source) = ''
UNION ALL SELECT id, 'last_seen_at', 'can''t be blank' FROM broken WHERE last_seen_at IS NULL
UNION ALL SELECT id, 'hybrid_remote_days_min_per_week', 'must be between 1 and 5' FROM broken WHERE days NOT BETWEEN 1 AND 5
UNION ALL SELECT id, 'score', 'must be between 0 and 100' FROM broken WHERE score > 100
UNION ALL SELECT id, 'city', 'is too long' FROM broken WHERE repeats * 10 > 255
UNION ALL SELECT id, 'location_mode', 'is not an allowed value' FROM broken WHERE location_mode = 'office'""")
def dq_violations(spark, folder):
    key = F.col("id")
    broken = offers_base(spark, folder).withColumns({
        "source": F.when(key % 21 != 0, F.col("source")).otherwise(" "),
        "last_seen_at": F.when(key % 22 != 0, F.col("last_seen_at")),
        "hybrid_remote_days_min_per_week": F.when(key % 8 == 0, 6).otherwise(
            F.col("hybrid_remote_days_min_per_week")),
        "score": (key % 150).cast("int"),
        "city": F.repeat(F.lit("x" * 10), (key % 30).cast("int")),
        "location_mode": F.when(key % 19 == 0, "office").otherwise(F.col("location_mode")),
    })
    return quality.offer_violations(broken)


@register("dq_duplicates", "O-DQ-2", """
SELECT url_hash, count(*) AS rows FROM (
  SELECT sha256('https://example.com/' || user_id || '/' || event_type) AS url_hash FROM events)
GROUP BY url_hash HAVING count(*) > 1""")
def dq_duplicates(spark, folder):
    url = F.concat(F.lit("https://example.com/"), F.col("user_id").cast("string"),
                   F.lit("/"), F.col("event_type"))
    rows = table(spark, folder, "events").select(text.url_key(url).alias("url_hash"))
    return quality.duplicates(rows, "url_hash")


STEP_DOCS = [
    '{"discovery":{"at":"2026-03-20T09:00:00Z","version":1}}',
    '{"publish":{"at":"2026-03-20T09:00:00Z"},"fetch":{"version":2}}',
    '{"discovery":"invalid"}',
    '{"discovery":{"at":"2026-03-20T09:00:00+01:00","version":1,"source":"manual"}}',
    '{"fetch":{"at":"not-iso8601","version":0}}',
    "[]", "{}", "",
]
_STEP_MESSAGES = [
    [], ["contains unsupported step publish"], ["step discovery must be a hash"],
    ["step discovery contains unsupported keys source"],
    ["step fetch has an invalid at timestamp", "step fetch has an invalid version"],
    ["must be a hash"], [], [],
]


@register("dq_steps", "O-DQ-5", "WITH docs AS (SELECT o_orderkey AS id, unnest(list_extract(["
          + ", ".join("CAST([" + ", ".join(sql_text(m) for m in ms) + "] AS VARCHAR[])" for ms in _STEP_MESSAGES)
          + "], CAST(o_orderkey % 8 + 1 AS INTEGER))) AS message FROM orders) SELECT id, message FROM docs")
def dq_steps(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        key.alias("id"), pick(STEP_DOCS, key).alias("steps_details"))
    return quality.steps_violations(rows)


PROFILES = [
    '{"technology":{"primary":["ruby"],"secondary":[]},"location":{"preference":["remote","hybrid"],"city":["Nantes"],'
    '"hybrid":{"remote_days_min_per_week":2},"on_site":{"city":["Paris"]}},"extra":1}',
    '{"technology":{"secondary":[]},"location":{}}',
    '{"technology":{"primary":[],"secondary":"x"},"location":{}}',
    '{"technology":{"primary":[],"secondary":[]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"city":[]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote","office"]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote","remote"]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote"],"city":["a"," "]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote"],"hybrid":[]}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote"],"hybrid":{"city":["a"]}}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote"],"hybrid":{"city":[1],"remote_days_min_per_week":"2"}}}',
    '{"technology":{"primary":[],"secondary":[]},"location":{"preference":["remote"],"on_site":{"city":"Paris"}}}',
    "{",
]
_PROBLEMS = [
    None, "Missing technology.primary", "Missing technology.secondary", "Missing location",
    "Missing location.preference", "Invalid location.preference", "Invalid location.preference",
    "Invalid location.city", "Invalid location.hybrid",
    "Missing location.hybrid.remote_days_min_per_week", "Invalid location.hybrid.city",
    "Invalid location.on_site.city", "Invalid JSON in scoring profile",
]


@register("profile_rules", "O-DQ-6 O-SRC-4", "SELECT c_custkey AS id, list_extract(["
          + ", ".join("NULL" if p is None else sql_text(p) for p in _PROBLEMS)
          + "], CAST(c_custkey % 13 + 1 AS INTEGER)) AS problem,"
            " CASE c_custkey % 13 WHEN 0 THEN 'remote|hybrid' WHEN 5 THEN 'remote|office'"
            " WHEN 6 THEN 'remote|remote' WHEN 7 THEN 'remote' WHEN 8 THEN 'remote' WHEN 9 THEN 'remote'"
            " WHEN 10 THEN 'remote' WHEN 11 THEN 'remote' END AS preference FROM customer")
def profile_rules(spark, folder):
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("id"), pick(PROFILES, key).alias("profile"))
    return parse_profiles(rows).select(
        "id", "problem", F.array_join("parsed.location.preference", "|").alias("preference"))


# --- reshapes ----------------------------------------------------------------

@register("steps_pivot", "O-FN-17", f"""WITH {BASE_SQL}
SELECT id, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  CASE WHEN id % 2 <> 0 THEN strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') END AS fetched_at,
  CASE WHEN id % 5 <> 0 THEN strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') END AS enriched_at,
  CASE WHEN id % 7 <> 0 THEN strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') END AS scored_at FROM base""")
def steps_pivot(spark, folder):
    rows = offers_base(spark, folder).select("id", "steps_details")
    back = migrate.steps_to_columns(migrate.columns_to_steps(migrate.steps_to_columns(rows)))
    return back.select("id", *[
        ts_text(F.col(c)).alias(c) for c in migrate.STEP_COLUMNS.values()])


@register("mode_remap", "O-FN-18", f"""WITH {BASE_SQL}
SELECT id, CASE location_mode WHEN 'remote' THEN 'yes' WHEN 'on-site' THEN 'no' WHEN 'hybrid' THEN 'hybrid' END AS remote,
  location_mode AS back FROM base""")
def mode_remap(spark, folder):
    remote = migrate.remote_from_mode(F.col("location_mode"))
    return offers_base(spark, folder).select(
        "id", remote.alias("remote"), migrate.mode_from_remote(remote).alias("back"))


@register("array_recode", "O-FN-19 O-AGG-10", f"""WITH {OFFERS_SQL}
SELECT id, CAST(to_json(primary_technologies) AS VARCHAR) AS as_json,
  array_to_string(primary_technologies, '|') AS as_array, '' AS from_null FROM offers""")
def array_recode(spark, folder):
    rows = offers_view(spark, folder).select(
        "id", array_to_json(F.col("primary_technologies")).alias("as_json"))
    stored = rows.withColumns({
        "primary_technologies": F.col("as_json"),
        "secondary_technologies": F.lit(None).cast("string")})
    return migrate.technologies_to_arrays(stored).select(
        "id", "as_json", F.array_join("primary_technologies", "|").alias("as_array"),
        F.array_join("secondary_technologies", "|").alias("from_null"))


@register("pages_migration", "O-SNK-4 O-JN-6", f"""WITH {BASE_SQL}
SELECT id, CASE WHEN rejected THEN 'stored ' || id WHEN id % 3 = 0 THEN NULL ELSE '<p>' || id || '</p>' END AS html_content
FROM base""")
def pages_migration(spark, folder):
    """The pages of rejected offers are stored already; some offers have no page."""
    key = F.col("id")
    offers = offers_base(spark, folder).withColumn(
        "html_content",
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("<p>"), key.cast("string"), F.lit("</p>"))))
    stored = offers.where("rejected").select(
        "url_hash", "url", "source",
        F.concat(F.lit("stored "), key.cast("string")).alias("html"))
    merged = stored.unionByName(migrate.pages_to_store(offers, stored))
    return migrate.pages_to_column(offers, merged).select("id", "html_content")


# --- job status --------------------------------------------------------------

@register("job_classes", "O-AGG-5", f"WITH {JOB_CLASS_SQL} SELECT event_id, state, job_class FROM jobs")
def job_classes(spark, folder):
    return job_runs_view(spark, folder).select(
        "event_id", "state", metrics.job_class(F.col("item")).alias("job_class"))


@register("job_status", "O-AGG-4 O-STR-3", f"""WITH {JOB_CLASS_SQL}, ours AS (
  SELECT state FROM jobs WHERE starts_with(job_class, 'Sourcing::') AND state <> 'done')
SELECT count(*) > 0 AS active, count(*) FILTER (WHERE state = 'queued') AS queued_count,
  count(*) FILTER (WHERE state = 'running') AS running_count, '{NOW_TEXT}' AS updated_at FROM ours""")
def job_status(spark, folder):
    return metrics.job_status(job_runs_view(spark, folder), now()).withColumn(
        "updated_at", ts_text(F.col("updated_at")))


# on the events' own time axis: four notices an event, and four around the end of its hour, so that chunks hand over to the next
@register("throttle", "O-STR-2", """WITH RECURSIVE given AS (
  SELECT event_type AS key, epoch_us(ts) // 1000 AS t, (epoch_us(ts) // 1000 // 3600000 + 1) * 3600000 AS border FROM events),
times AS MATERIALIZED (
  SELECT DISTINCT key, CAST(ms AS BIGINT) AS ms FROM (
    SELECT key, t + unnest([0, 400, 1000, 1700]) AS ms FROM given
    UNION ALL SELECT key, border + t % 400 + unnest([-800, -400, 0, 400]) AS ms FROM given)),
jumps AS MATERIALIZED (
  SELECT a.key, a.ms, b.ms AS later FROM times a ASOF JOIN times b ON a.key = b.key AND a.ms + 1000 <= b.ms),
sent(key, ms) AS (
  SELECT key, ms FROM (SELECT *, lag(ms) OVER (PARTITION BY key ORDER BY ms) AS before FROM times)
  WHERE before IS NULL OR ms >= before + 1000
  UNION
  SELECT j.key, j.later FROM sent JOIN jumps j ON j.key = sent.key AND j.ms = sent.ms)
SELECT key, ms FROM sent""")
def throttle(spark, folder):
    return throttled(hourly_notices(table(spark, folder, "events"))).select("key", F.unix_millis("ts").alias("ms"))


def hourly_notices(events):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    border = (F.floor(at / CHUNK_MS) + 1) * CHUNK_MS + at % 400
    times = F.array(*[at + n for n in (0, 400, 1000, 1700)], *[border + n for n in (-800, -400, 0, 400)])
    # narrow rows are spread before each becomes eight
    events = spread(events.select("event_id", "event_type", "ts"), "event_id")
    return events.select(F.col("event_type").alias("key"), F.explode(times).alias("ms")).select(
        "key", F.timestamp_millis("ms").alias("ts"))
