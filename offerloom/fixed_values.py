"""Lists, codes and patterns that results depend on.

Everything in this file is data. The values are given as plain text, in their
natural order, and are read by the Column builders in ``functions`` and
``operators``. Patterns are written for Java's regex engine: ``(?iu)`` stands
for case-insensitive matching that also covers accented letters.
"""

# --- Offer table -----------------------------------------------------------

STEPS = ["discovery", "fetch", "analyze", "enrich", "score"]

LOCATION_MODES = ["remote", "hybrid", "on-site"]
EMPLOYMENT_TYPES = [
    "PERMANENT", "FIXED_TERM", "CONTRACT", "FREELANCE", "INTERNSHIP",
    "APPRENTICESHIP", "TEMPORARY", "FULL_TIME", "PART_TIME",
]
OFFER_LANGUAGES = ["fr", "en", "other"]
SENIORITY_LEVELS = ["intern", "junior", "mid", "senior", "staff"]
ENGLISH_LEVELS = ["none", "basic", "professional", "fluent"]

ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:\d{2})$"

SORT_KEYS = ["first_seen_at", "last_seen_at", "score", "company", "title"]
DATE_PRESETS = ["today", "yesterday", "last_7_days", "last_30_days"]

LIST_COLUMNS = [
    "id", "title", "company", "city", "source", "location_mode", "score",
    "first_seen_at", "last_seen_at",
]
DETAIL_COLUMNS = [
    "id", "title", "company", "city", "url", "source", "location_mode",
    "employment_type", "score", "score_breakdown", "description_html",
    "primary_technologies", "secondary_technologies", "salary_min_minor",
    "salary_max_minor", "salary_currency", "posted_at", "first_seen_at",
]

# --- Sources ---------------------------------------------------------------

STEP_VERSIONS = {
    # source: (discovery, fetch, analyze, enrich)
    "linkedin": (1, 1, 3, 1),
    "france_travail": (1, 1, 1, 1),
    "cadremploi": (1, 1, 1, 1),
    "hellowork": (1, 1, 2, 1),
    "apec": (1, 1, 1, 1),
    "wttj": (1, 1, 1, 2),
}
SCORE_VERSION = 2

PAGE_CAPS = {
    "linkedin": 10, "france_travail": 1, "cadremploi": 10,
    "hellowork": 10, "apec": 25, "wttj": 10,
}

LINK_PATTERNS = {
    "linkedin": r"/jobs/view/",
    "france_travail": r"/offres/recherche/detail/",
    "cadremploi": r"/emploi/detail_offre\?offreId=",
    "hellowork": r"/fr-fr/emplois/.*\.html$",
    "apec": r"/candidat/recherche-emploi\.html/emploi/detail-offre/",
    "wttj": r"^/fr/companies/.*/jobs/",
}

OFFER_URL_SHAPES = {
    "hellowork": r"/fr-fr/emplois/\d+\.html",
    "apec": r"/emploi/detail-offre/\d+[A-Z]?",
}

SEARCH_BASES = {
    "linkedin": "https://www.linkedin.com/jobs/search/",
    "france_travail": "https://candidat.francetravail.fr/offres/recherche",
    "cadremploi": "https://www.cadremploi.fr/emploi/liste_offres",
    "hellowork": "https://www.hellowork.com/fr-fr/emploi/recherche.html",
    "apec": "https://www.apec.fr/candidat/recherche-emploi.html/emploi",
    "wttj": "https://www.welcometothejungle.com/fr/jobs",
}
FRANCE_TRAVAIL_HOST = "https://candidat.francetravail.fr"

LINKEDIN_RESULTS_PER_PAGE = 25
LINKEDIN_MODE_CODES = {"remote": "2", "hybrid": "3", "on-site": "1"}
WTTJ_MODE_CODES = {
    "remote": "fulltime", "hybrid": "partial", "on-site": "no",
    "onsite": "no", "punctual": "punctual",
}
APEC_MODE_CODES = {"remote": ["20767"], "hybrid": ["20765", "20766"]}
APEC_COMPANY_TYPES = ["143684", "143685", "143686", "143687", "143706"]
APEC_RESULTS_PER_PAGE = 20
HELLOWORK_FULL_PAGE = 30

# --- Page checks -----------------------------------------------------------

SHELL_PAGES = [
    "<html><head></head><body></body></html>",
    "<html><body></body></html>",
]
LOGIN_PAGE = r"(?iu)checkpoint|challenge|captcha|authwall|login|sign in|security verification"
BOT_WALL_PAGE = (
    r"(?iu)cloudflare|captcha|challenge|access denied|forbidden|verify you are human|robot"
)
CADREMPLOI_WALL_TITLE = r"(?iu)just a moment"
CADREMPLOI_WALL_BODY = r"(?iu)checking your browser|cf[- ]?challenge|cloudflare"
NOT_AN_OFFER = {
    "hellowork": r"(?iu)erreur 404|page non trouv[ée]e|not found",
    "apec": (
        r"(?iu)offre non disponible|offre expir[ée]e|page non trouv[ée]e|erreur 404|not found"
    ),
}
NO_RESULTS_PAGE = r"(?iu)0\s+offres correspondent|aucune offre ne correspond"
APEC_REFERENCE = r"(?iu)Ref\. Apec"
MIN_BODY_TEXT = {"linkedin": 400, "hellowork": 400, "apec": 600}
APEC_MIN_DETAIL_BLOCKS = 4

# --- Contract type, one ordered list per source -----------------------------

CONTRACT_RULES = {
    "linkedin": [
        (r"(?iu)\bcdi\b|permanent", "PERMANENT"),
        (r"(?iu)\bcdd\b|fixed\s?-?term", "FIXED_TERM"),
        (r"(?iu)contract|contrat", "CONTRACT"),
        (r"(?iu)freelance|indépendant|independant", "FREELANCE"),
        (r"(?iu)stage|internship|\bintern\b", "INTERNSHIP"),
        (r"(?iu)alternance|apprenticeship", "APPRENTICESHIP"),
        (r"(?iu)interim|intérim|temporary", "TEMPORARY"),
        (r"(?iu)temps plein|full-time|full time", "FULL_TIME"),
        (r"(?iu)temps partiel|part-time|part time", "PART_TIME"),
    ],
    "cadremploi": [
        (r"\bCDI\b", "PERMANENT"),
        (r"\bCDD\b", "FIXED_TERM"),
        (r"(?iu)full[-_ ]?time|temps plein", "FULL_TIME"),
        (r"(?iu)part[-_ ]?time|temps partiel", "PART_TIME"),
        (r"(?iu)alternance|apprentissage|professionnalisation", "APPRENTICESHIP"),
        (r"(?iu)\bstage\b", "INTERNSHIP"),
        (r"(?iu)int[eé]rim", "TEMPORARY"),
        (r"(?iu)lib[eé]rale|portage|freelance", "FREELANCE"),
        (r"(?iu)contractuel", "FIXED_TERM"),
    ],
    "hellowork": [
        (r"(?iu)\bCDI\b", "PERMANENT"),
        (r"(?iu)\bCDD\b", "FIXED_TERM"),
        (r"(?iu)alternance|apprentissage|professionnalisation", "APPRENTICESHIP"),
        (r"(?iu)\bstage\b", "INTERNSHIP"),
        (r"(?iu)freelance|ind[ée]pendant", "FREELANCE"),
        (r"(?iu)int[ée]rim|temporaire", "TEMPORARY"),
        (r"(?iu)full[-_ ]?time|temps plein", "FULL_TIME"),
        (r"(?iu)part[-_ ]?time|temps partiel", "PART_TIME"),
    ],
    "apec": [
        (r"(?iu)\bCDI\b", "PERMANENT"),
        (r"(?iu)\bCDD\b", "FIXED_TERM"),
        (r"(?iu)alternance|apprentissage|professionnalisation", "APPRENTICESHIP"),
        (r"(?iu)\bstage\b", "INTERNSHIP"),
        (r"(?iu)freelance|ind[ée]pendant", "FREELANCE"),
        (r"(?iu)int[ée]rim|temporaire", "TEMPORARY"),
        (r"(?iu)temps plein|full[-_ ]?time", "FULL_TIME"),
        (r"(?iu)temps partiel|part[-_ ]?time", "PART_TIME"),
    ],
    "france_travail": [
        (r"\bCDI\b", "PERMANENT"),
        (r"\bCDD\b", "FIXED_TERM"),
        (r"(?iu)int[eé]rim|mission intérimaire", "TEMPORARY"),
        (r"(?iu)alternance|apprentissage|professionnalisation", "APPRENTICESHIP"),
        (r"(?iu)\bstage\b", "INTERNSHIP"),
        (r"(?iu)lib[eé]rale|portage salarial|freelance", "FREELANCE"),
        (r"(?iu)saisonni", "FIXED_TERM"),
    ],
    "wttj": [
        (r"(?iu)full_time", "PERMANENT"),
        (r"(?iu)cdi", "PERMANENT"),
        (r"(?iu)temporary|temp", "TEMPORARY"),
        (r"(?iu)cdd", "FIXED_TERM"),
        (r"(?iu)freelance", "FREELANCE"),
        (r"(?iu)stage", "INTERNSHIP"),
        (r"(?iu)alternance|apprentissage", "APPRENTICESHIP"),
        (r"(?iu)intérim|interim|temporaire", "TEMPORARY"),
        (r"(?iu)temps plein|full[- ]?time", "FULL_TIME"),
        (r"(?iu)temps partiel|part[- ]?time", "PART_TIME"),
    ],
}

# --- Work mode, one ordered list per source ---------------------------------

MODE_RULES = {
    "linkedin": [
        (r"(?iu)hybrid|hybride", "hybrid"),
        (r"(?iu)on\s?-\s?site|on site|sur site|in office|présentiel|presentiel", "on-site"),
        (r"(?iu)remote|teletravail|télétravail|a distance|à distance", "remote"),
    ],
    "cadremploi": [
        (r"(?iu)t[eé]l[eé]travail total|full.?remote|100.*remote", "remote"),
        (r"(?iu)hybride|t[eé]l[eé]travail partiel|quelques jours", "hybrid"),
        (r"(?iu)sur site|pr[eé]sentiel|on[- ]?site", "on-site"),
    ],
    "hellowork": [
        (
            r"(?iu)t[ée]l[ée]travail total|100\s*%\s*t[ée]l[ée]travail|full[-_ ]?remote",
            "remote",
        ),
        (r"(?iu)t[ée]l[ée]travail partiel|hybride|occasionnel|\b\d+\s*jours\b", "hybrid"),
        (r"(?iu)sur site|pr[ée]sentiel|on[-_ ]?site", "on-site"),
    ],
    "apec": [
        (
            r"(?iu)total possible|t[ée]l[ée]travail permanent|full[-_ ]?remote|100\s*%",
            "remote",
        ),
        (r"(?iu)partiel possible|ponctuel autoris[ée]|hybride|2-3j|2 jours|3 jours", "hybrid"),
        (r"(?iu)pr[ée]sentiel|sur site|on[-_ ]?site", "on-site"),
    ],
    "france_travail": [
        (
            r"(?iu)t[eé]l[eé]travail (?:total|complet|int[eé]gral)"
            r"|100\s*%\s*t[eé]l[eé]|full[- ]?remote",
            "remote",
        ),
        (r"(?iu)t[eé]l[eé]travail|hybride?", "hybrid"),
        (
            r"(?iu)pr[eé]sentiel|sur site|site client|pas de t[eé]l[eé]travail"
            r"|aucun t[eé]l[eé]travail",
            "on-site",
        ),
    ],
    "wttj": [
        (r"(?iu)partial|hybride|partiel|quelques jours", "hybrid"),
        (r"(?iu)full remote|full_remote|remote|full", "remote"),
        (r"(?iu)none|no_remote", "on-site"),
        (r"(?iu)télétravail total|full remote|remote", "remote"),
        (r"(?iu)hybride|partiel|quelques jours", "hybrid"),
        (r"(?iu)sur site|on[- ]?site|présentiel", "on-site"),
    ],
}
TELECOMMUTE = r"(?iu)TELECOMMUTE"
WTTJ_MODE_LABELS = (
    r"(?iu)Télétravail|Remote|Hybride|sur site|présentiel|on[- ]?site"
)

# --- Salary -----------------------------------------------------------------

CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
CURRENCY_CODES = ["EUR", "USD", "GBP"]
LINKEDIN_SALARY_GATE = r"(?iu)salary|compensation|pay\s*range|remuneration|salaire"
LINKEDIN_SALARY_RANGE = (
    r"(?iu)(€|\$|£|\bEUR\b|\bUSD\b|\bGBP\b)?\s*(\d[\d\s.,]*\s*[kK]?)\s*(?:-|to|a|à)\s*"
    r"(€|\$|£|\bEUR\b|\bUSD\b|\bGBP\b)?\s*(\d[\d\s.,]*\s*[kK]?)"
)
LINKEDIN_MIN_SALARY_MINOR = 10_000
CADREMPLOI_SALARY_RANGE = r"(?iu)(\d[\d\s]*)\s*KEUR\s*[-–]\s*(\d[\d\s]*)\s*KEUR"
CADREMPLOI_SALARY_SINGLE = r"(?iu)(\d[\d\s]*)\s*KEUR"
CADREMPLOI_SALARY_UNKNOWN = r"(?iu)selon.*profil|non.*spécifié"
HELLOWORK_SALARY_RANGE = r"(\d[\d\s]+)\s*[-–]\s*(\d[\d\s]+)\s*[€$£]"
HELLOWORK_SALARY_SINGLE = r"(\d[\d\s]+)\s*[€$£]"
APEC_SALARY_UNKNOWN = r"(?iu)n[ée]gocier"
APEC_SALARY_NUMBER = r"\d+(?:[.,]\d+)?"
APEC_SALARY_THOUSANDS = r"(?iu)k\s*€|k€|\bk\b"
WTTJ_SALARY_RANGE = r"(?iu)(\d+[\sKk]*)[\sà\-]+(\d+[\sKk]*)"
WTTJ_SALARY_SINGLE = r"(?iu)(\d+[\sKk]*)"
WTTJ_SALARY_UNKNOWN = r"(?iu)non spécifié"

# --- Dates ------------------------------------------------------------------

TODAY_WORDS = r"\b(today|aujourd'hui|just now|à l'instant)\b"
AGO_UNITS = (
    "minute|minutes|min|hour|hours|hr|day|days|jour|jours|week|weeks|semaine|semaines"
    "|month|months|mois"
)
AGO_UNITS_EN = "minute|minutes|min|hour|hours|hr|day|days|week|weeks|month|months"
AGO_UNITS_FR = "minute|min|heure|heures|jour|jours|semaine|semaines|mois"
UNIT_OF_WORD = {
    "minute": ["minute", "minutes", "min"],
    "hour": ["hour", "hours", "hr"],
    "day": ["day", "days", "jour", "jours"],
    "week": ["week", "weeks", "semaine", "semaines"],
    "month": ["month", "months", "mois"],
}
LISTED_AT_MILLIS = r'"listedAt"\s*:\s*(\d{13})'
LAST_MONTH = r"(?iu)\ble mois dernier\b|\blast month\b"

# --- Places -----------------------------------------------------------------

LOCATION_NOISE = [
    "engineer", "developer", "software", "backend", "front", "frontend",
    "fullstack", "full-stack", "stack", "ruby", "rails", "junior", "senior",
    "lead", "principal", "stage", "intern", "internship", "alternance",
    "apprentice", "apprenticeship",
]
FRENCH_TRIPLET = r"(?iu)([A-Za-zÀ-ÿ'\- ]+?,\s*[A-Za-zÀ-ÿ'\- ]+,\s*France)\b"
METRO_REGION = r"(?iu)((?:Greater\s+)?[A-Za-zÀ-ÿ'\- ]+\s+Metropolitan\s+Region)"
TOPCARD_LINE = (
    r"(?iu)((?:Greater\s+)?[A-Za-zÀ-ÿ'\- ]+\s+Metropolitan\s+Region"
    r"|[A-Za-zÀ-ÿ'\- ]+,\s*[A-Za-zÀ-ÿ'\- ]+,\s*France)\s*[·•|\-]\s*(.{0,300})"
)
TOPCARD_CUT = r"(?iu)\b(test technique|process:)\b.*$"
MODE_WORDS = (
    r"on\s*-\s*site|hybrid|hybride|remote|sur site|pr[ée]sentiel|teletravail"
    r"|t[ée]l[ée]travail|a distance|à distance"
)
TOPCARD_MODE_PAREN = r"(?iu)\([ ]*(on\s*-\s*site|hybrid|remote)[ ]*\)"
TOPCARD_MODE_CHIPS = (
    r"(?iu)\b(" + MODE_WORDS + r")\s*"
    r"(?:full\s*-?\s*time|part\s*-?\s*time|temps\s+plein|temps\s+partiel)?\s*"
    r"(?:easy\s+apply|candidature\s+simplifi[ée]e)?\s*"
    r"(?:applysave|apply|save|postuler|enregistrer|see how you compare)"
)
TOPCARD_MODE_LINE = (
    r"(?iu)(?:[A-Za-zÀ-ÿ'\- ]+?,\s*[A-Za-zÀ-ÿ'\- ]+,\s*France"
    r"|[A-Za-zÀ-ÿ'\- ]+\s+Metropolitan\s+Region)\s*[·•|\-]\s*.{0,800}?(" + MODE_WORDS + ")"
)
TOPCARD_MODE_FRANCE = r"(?iu)France\s*[·•|\-]\s*.{0,800}?(" + MODE_WORDS + ")"

# --- Description sections ---------------------------------------------------

HELLOWORK_SECTIONS = (
    r"(?iu)d[ée]tail du poste|missions? du poste|profil recherch|avantages?"
    r"|infos? compl[ée]mentaires?|bienvenue chez|comp[ée]tences?|stack technique"
)
CADREMPLOI_SECTIONS = r"(?iu)missions|poste|profil|requis|id[eé]al"
NON_CONTENT_TAGS = ["script", "style", "nav", "footer", "aside", "button", "svg", "use"]

# --- Relevance --------------------------------------------------------------

SYMBOL_ALIASES = [
    (r"(?i)c\+\+", "cpp"),
    (r"(?i)c#", "csharp"),
    (r"(?i)\.net", "dotnet"),
    (r"(?i)node\.js", "nodejs"),
]

# --- Model response ---------------------------------------------------------

RESPONSE_KEYS = [
    "hybrid_remote_days_min_per_week", "primary_technologies",
    "secondary_technologies", "offer_language", "normalized_seniority",
    "english_level_required",
]
LINKEDIN_RESPONSE_KEYS = ["location_mode", "city"] + RESPONSE_KEYS

# --- Job status -------------------------------------------------------------

JOB_PREFIX = "Sourcing::"
STATUS_THROTTLE_MS = 1000
