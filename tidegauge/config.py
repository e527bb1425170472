"""Constants of the index: word lists, weights, limits and versions. Every operator takes them as defaults."""

from __future__ import annotations

BASELINE = 1000.0
IMPACT_MULTIPLIER = 10.0
SCORING_VERSION = "score-v1"
CALCULATION_VERSION = "calc-v1"
MAX_ARTICLES = 40
MAX_DEDUPLICATED = 80
MAX_HISTORY = 500
MOVERS = 5
REFRESH_MINUTES = 30
RESULT_TTL_MINUTES = 5
MAX_RATIONALE = 600
MAX_DURATION_HOURS = 8760.0
NOVELTY_HOURS = 168.0
DEFAULT_CATEGORY = "governance"

#: Word lists; order inside a list has no meaning.
NEGATIVE_TERMS = tuple(sorted(
    "abuse climate collapse crisis dead death disaster disease earthquake explosion famine flood hurricane injured killed "
    "outbreak pandemic pollution protest recession sanction shooting strike violence war wildfire attack".split()
))
POSITIVE_TERMS = tuple(sorted(
    "agreement aid approval approved breakthrough ceasefire conservation cure discovery donation freed peace protected "
    "recovery released relief renewable rescue restored treatment vaccine wins".split()
))
#: Categories in the order in which they are tried; the terms of one in any order.
CATEGORY_TERMS: dict[str, tuple[str, ...]] = {
    name: tuple(sorted(terms.split(",")))
    for name, terms in {
        "conflict": "military,hostage,ceasefire,war,violence,strike,attack",
        "disaster": "eruption,storm,wildfire,disaster,hurricane,flood,earthquake",
        "health": "medical,vaccine,hospital,outbreak,disease,treatment,health",
        "environment": "wildlife,emissions,renewable,pollution,climate,environment",
        "economy": "tariff,jobs,trade,inflation,market,recession,economy",
        "science": "study,space,discovery,research,science",
        "technology": "software,internet,cyber,artificial intelligence,technology",
        "rights": "freed,arrested,justice,election,migrant,refugee,rights",
        "governance": "president,minister,court,law,policy,government",
        "culture": "music,film,sport,culture",
    }.items()
}
_BY_WEIGHT = {1.2: "conflict", 1.1: "health rights environment disaster", 1.0: "governance economy", 0.9: "technology science", 0.7: "culture"}
CATEGORY_WEIGHTS: dict[str, float] = {name: weight for weight, names in _BY_WEIGHT.items() for name in names.split()}
CATEGORIES = tuple(sorted(CATEGORY_WEIGHTS))
STRONG_WORDS = "catastrophic|deadly|devastating|historic|major|mass|urgent"
GLOBAL_WORDS = "countries|global|international|millions|nationwide|world"
REGIONAL_WORDS = "city|national|region|state|thousands"
LASTING_WORDS = "climate|pandemic|recession|war"
LONG_CATEGORIES = ("conflict", "economy", "environment", "health")
DURATION_LASTING, DURATION_LONG, DURATION_SHORT = 1440.0, 336.0, 72.0

NO_SUMMARY = "The publisher gave no excerpt."
NO_LOCATION = "Not extracted"
NOTE_ASSESSED = "Assessed by an external model from headline and excerpt; no human has reviewed it."
NOTE_FALLBACK = "No model assessment was available; scored by keywords."

STATUSES = ("emerging", "confirmed", "updated", "resolved", "disputed")
SCOPES = ("local", "national", "regional", "global")
#: name: (feed's host, feed's path, home page's host, home page's path, language, reliability, bias note)
_SOURCES = {
    "Al Jazeera": ("https://www.aljazeera.com", "/xml/rss/all.xml", "https://www.aljazeera.com", "", "en", 0.75, "Based in Qatar, with a wider view of the Middle East"),
    "BBC World": ("http://feeds.bbci.co.uk", "/news/world/rss.xml", "https://www.bbc.com", "/news/world", "en", 0.8, "Public broadcaster of the UK"),
    "NPR World": ("https://feeds.npr.org", "/1004/rss.xml", "https://www.npr.org", "/sections/world/", "en", 0.8, "Public radio of the US"),
}
#: (name, feed url, home page, language, reliability, bias note)
SOURCES = tuple((name, s[0] + s[1], s[2] + s[3], *s[4:]) for name, s in _SOURCES.items())
