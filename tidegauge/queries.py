"""The registered queries over the test tables, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import numbers as N
from .functions import text as X
from .functions import times as D
from .operators import articles as A
from .operators import assessments as M
from .operators import events as E
from .operators import index as I
from .operators import matching
from .operators import scoring as S
from .plans import datasets as data
from .plans import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments --------------------------------------------------------------------


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else _text(v) if isinstance(v, str) else f"CAST('{v!r}' AS DOUBLE)" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_WHITE = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_strip = lambda c: f"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '{_WHITE}', ' ', 'g'))"
_key = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_hits = lambda terms: "(" + " + ".join(f"CAST(contains(txt, {_text(t)}) AS INT)" for t in terms) + ")"
_round2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_double = lambda x: f"CAST('{x}' AS DOUBLE)"
_clamp = lambda x, lo, hi: f"least(greatest({x}, {_double(lo)}), {_double(hi)})"
_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(txt, {_text(t)})' for t in terms)} THEN '{name}'" for name, terms in config.CATEGORY_TERMS.items()) + f" ELSE '{config.DEFAULT_CATEGORY}' END"
_NOW = f"TIMESTAMP '{data.NOW}'"
_HASH = (
    "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({c}, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), "
    "lambda h, ch: ((h * 31 + ch + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"
)
_digit = lambda p: f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // {36**p}) % 36 AS INT) + 1, 1)"
_BASE36 = "CASE WHEN h = 0 THEN '0' ELSE ltrim(" + " || ".join(_digit(p) for p in range(5, -1, -1)) + ", '0') END"

_ARTICLES = f"""
articles AS (
    SELECT d.source AS publisher, {_double(0.5)} + (CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INT) % 5) / {_double(10)} AS reliability,
           'https://example.com/doc/' || d.doc_id AS url, split_part(d.text, chr(10), 1) AS headline,
           CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) ELSE '' END AS excerpt,
           e.ts AS published_at, CAST(regexp_extract(d.source, '([0-9]+)', 1) AS BIGINT) AS source_ord, d.doc_id AS item_ord
    FROM documents d JOIN events e ON d.doc_id = e.event_id
    UNION ALL
    SELECT publisher, reliability, 'https://example.com/sample/' || i, headline, excerpt, CAST(at_text AS TIMESTAMP), -1, i
    FROM ({_values([(p, r, h, e, t, i) for i, (p, r, h, e, t) in enumerate(data.SAMPLES)])}) AS s(publisher, reliability, headline, excerpt, at_text, i)
)"""
_UNIQUE = """
ranked AS (SELECT *, %s AS headline_key, row_number() OVER (ORDER BY published_at DESC, source_ord, item_ord) AS rank FROM articles),
placed AS (
    SELECT *, min(rank) OVER (PARTITION BY headline_key) AS pos, row_number() OVER (PARTITION BY headline_key ORDER BY reliability DESC, rank) AS rn FROM ranked
),
uniq AS (SELECT * FROM placed WHERE rn = 1)""" % _key("headline")
_FEATURES = f"""
texts AS (SELECT *, {_strip("excerpt")} AS clean_excerpt FROM uniq),
lowered AS (SELECT *, lower(headline || ' ' || clean_excerpt) AS txt FROM texts),
counted AS (SELECT *, {_hits(config.NEGATIVE_TERMS)} AS negative_hits, {_hits(config.POSITIVE_TERMS)} AS positive_hits, {_CATEGORY} AS kw_category FROM lowered),
features AS (
    SELECT *, {_clamp(f"(positive_hits - negative_hits) / greatest(positive_hits + negative_hits, 1)", -1, 1)} AS kw_sentiment,
        {_clamp(f"{_double(0.25)} + CAST(greatest(positive_hits, negative_hits) AS DOUBLE) * {_double(0.13)} + CASE WHEN regexp_matches(txt, '{config.STRONG_WORDS}') THEN {_double(0.2)} ELSE {_double(0)} END", 0.2, 0.95)} AS kw_severity,
        CASE WHEN regexp_matches(txt, '{config.GLOBAL_WORDS}') THEN {_double(0.8)} WHEN regexp_matches(txt, '{config.REGIONAL_WORDS}') THEN {_double(0.55)} ELSE {_double(0.35)} END AS kw_scale,
        regexp_matches(txt, '{config.LASTING_WORDS}') AS kw_lasting,
        greatest({_double(0)}, (epoch_us({_NOW}) - epoch_us(published_at)) / {_double(3.6e9)}) AS age_hours
    FROM counted
)"""
_JSON = """
labelled AS (
    SELECT doc_id AS d, toxic, quality, CAST(doc_id AS VARCHAR) AS s,
        list_element(['health', 'economy', 'conflict', 'culture', 'weather'], CAST(doc_id % 5 + 1 AS INT)) AS category FROM labels
),
one AS (
    SELECT d, '{"url":"https://example.com/doc/' || s || '","category":"' || category || '","sentiment":' || CASE WHEN toxic = 1 THEN '-' ELSE '' END || '0.' || lpad(CAST(d * 7 % 100 AS VARCHAR), 2, '0')
        || ',"severity":' || CASE WHEN d % 7 = 0 THEN '"0.' || lpad(CAST(d * 3 % 100 AS VARCHAR), 2, '0') || '"' WHEN d % 11 = 0 THEN '3' ELSE '0.' || lpad(CAST(d * 3 % 100 AS VARCHAR), 2, '0') END
        || ',"scale":0.' || lpad(CAST(d * 13 % 100 AS VARCHAR), 2, '0') || ',"confidence":0.' || lpad(CAST(d * 17 % 100 AS VARCHAR), 2, '0')
        || ',"durationHours":' || CAST(d % 9000 AS VARCHAR) || ',"rationale":" label ' || CAST(quality AS VARCHAR) || ' "}' AS j FROM labelled
),
bodies AS (SELECT d, '{"assessments":[7,' || j || CASE WHEN d % 4 = 0 THEN ',' || replace(j, '"scale":0', '"scale":1') ELSE '' END || ']}' AS b FROM one),
answers AS (SELECT d AS response_ord, CASE WHEN d % 13 = 0 THEN 'sorry ' || b WHEN d % 6 = 0 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN d % 17 = 0 THEN '{}' ELSE b END AS raw FROM bodies),
unfenced AS (SELECT response_ord, regexp_replace(regexp_replace(trim(raw), '^```(json)?\\s*', '', 'i'), '\\s*```$', '') AS raw FROM answers),
elements AS (
    SELECT response_ord, unnest(range(CAST(json_array_length(raw, '$.assessments') AS BIGINT))) AS pos, raw FROM unfenced WHERE json_valid(raw) AND json_type(raw, '$.assessments') = 'ARRAY'
),
typed AS (SELECT response_ord, pos, json_extract(raw, '$.assessments[' || pos || ']') AS e FROM elements),
assessments AS (
    SELECT response_ord, pos, e->>'$.url' AS url, e->>'$.category' AS category, """ + ", ".join(
    f"least(greatest(CAST(e->>'$.{n}' AS DOUBLE), {_double(lo)}), {_double(hi)}) AS {'duration_hours' if n == 'durationHours' else n}" for n, (lo, hi) in M.NUMBERS.items()
) + """, substr(trim(e->>'$.rationale'), 1, 600) AS rationale
    FROM typed
    WHERE json_type(e) = 'OBJECT' AND """ + " AND ".join(f"json_type(e, '$.{n}') = 'VARCHAR'" for n in ("url", "category", "rationale")) + " AND " + " AND ".join(
    f"json_type(e, '$.{n}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')" for n in M.NUMBERS
) + f"""
    AND (e->>'$.category') IN ({', '.join(map(_text, config.CATEGORIES))})
),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY response_ord DESC, pos DESC) AS rn FROM assessments) WHERE rn = 1)"""
_SCORED = f"""
joined AS (
    SELECT f.*, l.url IS NOT NULL AS matched, coalesce(l.category, kw_category) AS category, coalesce(l.sentiment, kw_sentiment) AS sentiment, coalesce(l.severity, kw_severity) AS severity,
        coalesce(l.scale, kw_scale) AS scale, {_clamp("1 - age_hours / 168", 0.2, 0.95)} AS novelty,
        CASE WHEN l.url IS NOT NULL THEN {_clamp("l.confidence * reliability", 0, 1)} ELSE reliability END AS confidence, l.duration_hours AS m_duration, l.rationale AS m_rationale
    FROM features f LEFT JOIN latest l ON f.url = l.url
),
lasting AS (
    SELECT *, coalesce(m_duration, CASE WHEN kw_lasting THEN {_double(1440)} WHEN category IN ({', '.join(map(_text, config.LONG_CATEGORIES))}) THEN {_double(336)} ELSE {_double(72)} END) AS duration_hours FROM joined
),
weighted AS (
    SELECT *, CASE category {' '.join(f"WHEN '{k}' THEN {_double(v)}" for k, v in config.CATEGORY_WEIGHTS.items())} END AS category_weight,
        {_clamp("log10(duration_hours + 10) / 2", 0.5, 1.5)} AS duration_weight, 1 / greatest(duration_hours, 1) AS decay_rate FROM lasting
),
impacts AS (SELECT *, {_round2("sentiment * severity * scale * novelty * confidence * category_weight * duration_weight * 10")} AS impact FROM weighted),
scored AS (
    SELECT *, {_round2("impact * exp(-decay_rate * greatest(age_hours, 0))")} AS current_impact,
        CASE WHEN scale >= 0.8 THEN 'global' WHEN scale >= 0.55 THEN 'regional' ELSE 'local' END AS scope,
        coalesce(m_rationale, CASE WHEN sentiment = 0 THEN 'Headline and excerpt show no direction.' ELSE 'Keywords show ' || CASE WHEN sentiment > 0 THEN positive_hits ELSE negative_hits END || ' '
            || CASE WHEN sentiment > 0 THEN 'positive' ELSE 'negative' END || ' ' || category || CASE WHEN CASE WHEN sentiment > 0 THEN positive_hits ELSE negative_hits END = 1 THEN ' signal' ELSE ' signals' END
            || ' in headline and excerpt.' END) AS rationale
    FROM impacts
)"""
_NO_MODEL = "latest AS (SELECT NULL AS url, NULL AS category, NULL::DOUBLE AS sentiment, NULL::DOUBLE AS severity, NULL::DOUBLE AS scale, NULL::DOUBLE AS confidence, NULL::DOUBLE AS duration_hours, NULL AS rationale WHERE false)"
_KEYWORDS = f"WITH {_ARTICLES}, {_UNIQUE}, {_FEATURES} "
_ALL = f"WITH {_ARTICLES}, {_UNIQUE}, {_FEATURES}, {_JSON}, {_SCORED} "
_IDS = f"hashed AS (SELECT *, abs({_HASH.format(c='url')}) AS h FROM scored), named AS (SELECT *, 'rss_' || {_BASE36} AS event_id FROM hashed)"
_EVENTS = _ALL + ", " + _IDS + " "
_IMPACTS = f"""
impact_events AS (
    SELECT event_id AS id, ts, event_type AS category, list_element(['local', 'regional', 'global'], CAST(user_id % 3 + 1 AS INT)) AS scope,
        {_round2("CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END * least(value / 500, 1) * 10")} AS current_impact FROM events
)"""
_sums = "round(coalesce(sum(CASE WHEN current_impact > 0 THEN current_impact END), 0), 2) AS positive_sum, round(coalesce(sum(CASE WHEN current_impact < 0 THEN current_impact END), 0), 2) AS negative_sum, count(*) AS active_events"
_HOURS = f"WITH {_IMPACTS}, hours AS (SELECT date_trunc('hour', ts) AS snapshot_at, {_sums} FROM impact_events GROUP BY 1) "
_SERIES = _HOURS + """, points AS (
    SELECT *, floor((1000 + positive_sum + negative_sum) * 100 + 0.5) / 100 AS current_index,
        floor(coalesce((positive_sum + negative_sum) - lag(positive_sum + negative_sum) OVER (ORDER BY snapshot_at), 0) * 100 + 0.5) / 100 AS change_since_previous FROM hours
) """

# --- Spark inputs ---------------------------------------------------------------------


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return A.deduplicate(data.articles(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_features(_unique(spark, d), data.now())


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return M.last_of_each(M.parse_assessments(data.responses(spark, d)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return S.with_impact(S.with_assessments(_features(spark, d), _assessed(spark, d)))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.to_events(_scored(spark, d))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    sums = data.impact_events(spark, d).groupBy(hour.alias("snapshot_at")).agg(*I.impact_sums())
    return sums.select("snapshot_at", F.round("positive_sum", 2).alias("positive_sum"), F.round("negative_sum", 2).alias("negative_sum"), "active_events")


def _series(spark: SparkSession, d: str) -> DataFrame:
    return I.snapshot_series(_hours(spark, d))


# --- Scalars --------------------------------------------------------------------------


@query(f"SELECT doc_id, {_key('split_part(text, chr(10), 1)')} AS headline_key FROM documents")
def headline_keys(spark, d):
    return data.read(spark, d, "documents").select("doc_id", X.headline_key(F.substring_index("text", "\n", 1)).alias("headline_key"))


@query(f"SELECT page_id, {_strip('html')} AS stripped FROM pages")
def strip_html(spark, d):
    return data.read(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("stripped"))


@query(f"SELECT page_id, signed_hash, 'rss_' || {_BASE36} AS event_id FROM (SELECT page_id, signed_hash, abs(signed_hash) AS h FROM (SELECT page_id, {_HASH.format(c='url')} AS signed_hash FROM pages))")
def url_hash_id(spark, d):
    return data.read(spark, d, "pages").select("page_id", X.rolling_hash(F.col("url")).alias("signed_hash"), X.event_id(F.col("url")).alias("event_id"))


@query(_KEYWORDS + "SELECT url, negative_hits, positive_hits FROM features")
def term_counts(spark, d):
    return _features(spark, d).select("url", "negative_hits", "positive_hits")


@query(_KEYWORDS + "SELECT url, kw_category AS category FROM features")
def category_first_match(spark, d):
    return _features(spark, d).select("url", F.col("kw_category").alias("category"))


@query(_KEYWORDS + "SELECT url, round(kw_sentiment, 6) AS sentiment, round(kw_severity, 6) AS severity, kw_scale AS scale, kw_lasting AS lasting FROM features")
def severity_scale_duration(spark, d):
    return _features(spark, d).select("url", F.round("kw_sentiment", 6).alias("sentiment"), F.round("kw_severity", 6).alias("severity"), F.col("kw_scale").alias("scale"), F.col("kw_lasting").alias("lasting"))


@query(f"SELECT doc_id, round(age, 6) AS age_hours, round({_clamp('1 - age / 168', 0.2, 0.95)}, 6) AS novelty FROM (SELECT doc_id, greatest({_double(0)}, (epoch_us({_NOW}) - epoch_us(ts)) / {_double(3.6e9)}) AS age FROM documents JOIN events ON doc_id = event_id)")
def novelty_age(spark, d):
    rows = data.read(spark, d, "documents").select("doc_id").join(data.read(spark, d, "events"), F.col("doc_id") == F.col("event_id"))
    aged = rows.select("doc_id", D.age_hours(F.col("ts"), data.now()).alias("age"))
    return aged.select("doc_id", F.round("age", 6).alias("age_hours"), F.round(N.novelty(F.col("age")), 6).alias("novelty"))


@query(f"SELECT event_id, round({_clamp('log10(value * 4 + 10) / 2', 0.5, 1.5)}, 6) AS duration_weight FROM events")
def duration_weight(spark, d):
    return data.read(spark, d, "events").select("event_id", F.round(N.duration_weight(F.col("value") * 4), 6).alias("duration_weight"))


@query("SELECT event_id, round(1 / greatest(value / 10, 1), 9) AS decay_rate FROM events")
def decay_rate(spark, d):
    return data.read(spark, d, "events").select("event_id", F.round(N.decay_rate(F.col("value") / 10), 9).alias("decay_rate"))


@query(f"SELECT event_id, {_round2('value * exp(-(1 / greatest(value, 1)) * greatest(CAST(user_id % 50 - 5 AS DOUBLE), 0))')} AS current_impact FROM events")
def decayed_impact(spark, d):
    hours = (F.col("user_id") % 50 - 5).cast("double")
    return data.read(spark, d, "events").select("event_id", N.round2(N.current_impact(F.col("value"), N.decay_rate(F.col("value")), hours)).alias("current_impact"))


@query(f"SELECT l_orderkey, l_linenumber, {_round2('-(l_extendedprice * l_discount) / 3')} AS rounded FROM lineitem")
def half_up_rounding(spark, d):
    return data.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.round2(-(F.col("l_extendedprice") * F.col("l_discount")) / 3).alias("rounded"))


_BAD = "value / 250 - 1 AS sentiment, value / 450 AS severity, CASE WHEN user_id % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE value / 600 END AS scale, value / 400 AS novelty, value / 490 AS confidence, value - 50 AS duration_hours, CASE WHEN user_id % 4 = 0 THEN '  ' ELSE 'r' END AS rationale"
_bad_range = lambda c, lo, hi: f"CASE WHEN NOT (isfinite({c}) AND {c} >= {lo} AND {c} <= {hi}) THEN '{c} must be between {lo} and {hi}.' END"


@query(
    f"SELECT event_id, array_to_string(list_filter([{', '.join(_bad_range(*r) for r in S._RANGES)}, CASE WHEN duration_hours <= 0 THEN 'duration_hours must be positive.' END, "
    f"CASE WHEN trim(rationale) = '' THEN 'rationale is required.' END], lambda m: m IS NOT NULL), ' ') AS errors FROM (SELECT event_id, {_BAD} FROM events)"
)
def validate_scores(spark, d):
    rows = data.read(spark, d, "events").selectExpr(
        "event_id", "value / 250 - 1 AS sentiment", "value / 450 AS severity", "CASE WHEN user_id % 5 = 0 THEN double('nan') ELSE value / 600 END AS scale", "value / 400 AS novelty",
        "value / 490 AS confidence", "value - 50 AS duration_hours", "CASE WHEN user_id % 4 = 0 THEN '  ' ELSE 'r' END AS rationale",
    )
    return rows.select("event_id", F.array_join(S.validation_errors(), " ").alias("errors"))


@query(f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('millisecond', ts) WHEN 3 THEN date_trunc('second', ts)
    WHEN 4 THEN date_trunc('minute', ts) ELSE {_NOW} END AS published_at FROM events""")
def pubdate_parse(spark, d):
    """The events' times in the forms that feeds use, and texts that are no time."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    moved = F.date_format(ts - F.expr("interval 4 hours"), "EEE, d MMM yyyy HH:mm:ss")
    shown = (
        F.when(k == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 1, F.concat(moved, F.lit(" -0400")))
        .when(k == 2, F.concat(F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))).when(k == 3, F.concat(F.date_format(ts - F.expr("interval 5 hours"), "dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .when(k == 4, F.concat(F.date_format(ts, "d MMM yyyy HH:mm"), F.lit(" GMT"))).when(k == 5, "yesterday")
    )
    return data.read(spark, d, "events").select("event_id", D.parse_published(shown, data.now().cast("timestamp")).cast("timestamp_ntz").alias("published_at"))


@query(_ALL + "SELECT url, rationale, CASE WHEN matched THEN '%s' ELSE '%s' END AS note FROM scored" % (config.NOTE_ASSESSED, config.NOTE_FALLBACK))
def rationale_text(spark, d):
    return _scored(spark, d).select("url", "rationale", F.get("uncertainty_notes", 0).alias("note"))


@query(_ALL + "SELECT url, scale, scope FROM scored")
def scope_from_scale(spark, d):
    return _scored(spark, d).select("url", "scale", N.scope_of(F.col("scale")).alias("scope"))


@query(f"SELECT event_id, CASE WHEN x >= 0 THEN '+' ELSE '' END || printf('%.2f', x) AS change FROM (SELECT event_id, {_round2('value - 250')} AS x FROM events)")
def format_change(spark, d):
    return data.read(spark, d, "events").select("event_id", N.signed(N.round2(F.col("value") - 250)).alias("change"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def iso_times(spark, d):
    return data.read(spark, d, "events").select("event_id", D.iso(F.col("ts")).alias("at"))


# --- Articles and assessments ---------------------------------------------------------


@query(f"WITH {_ARTICLES} SELECT publisher, headline, url, published_at, excerpt FROM articles")
def articles_listing(spark, d):
    return A.listing(data.articles(spark, d))


@query(f"WITH {_ARTICLES} SELECT url, published_at FROM articles ORDER BY published_at DESC, source_ord, item_ord")
def articles_sorted(spark, d):
    return A.newest_first(data.articles(spark, d)).select("url", "published_at")


@query(f"WITH {_ARTICLES}, {_UNIQUE} SELECT headline_key, url, publisher, reliability, published_at FROM uniq")
def dedup_articles(spark, d):
    return _unique(spark, d).select("headline_key", "url", "publisher", "reliability", "published_at")


@query(f"WITH {_ARTICLES}, {_UNIQUE} SELECT url, headline_key FROM uniq ORDER BY pos LIMIT 40")
def dedup_top40(spark, d):
    return A.first_articles(_unique(spark, d)).select("url", "headline_key")


@query("SELECT source, count(n) AS n FROM (SELECT source, CASE WHEN n_chars > 3000 THEN 1 END AS n FROM documents) GROUP BY source UNION ALL SELECT 'silent', 0")
def article_counts_by_source(spark, d):
    sources = data.source_dimension(data.read(spark, d, "documents")).select("name").unionByName(spark.createDataFrame([("silent",)], "name string"))
    return A.counts_by_source(sources, data.read(spark, d, "documents").filter("n_chars > 3000").select(F.col("source").alias("publisher")))


@query(f"WITH {_JSON} SELECT response_ord, pos, url, category, sentiment, severity, scale, confidence, duration_hours, rationale FROM assessments")
def assessment_parse(spark, d):
    rows = M.parse_assessments(data.responses(spark, d))
    return rows.select("response_ord", F.col("pos").cast("bigint").alias("pos"), "url", "category", "sentiment", "severity", "scale", "confidence", "duration_hours", "rationale")


@query(f"WITH {_JSON} SELECT url, scale, rationale FROM latest")
def assessment_last_wins(spark, d):
    return _assessed(spark, d).select("url", "scale", "rationale")


@query(f"WITH {_ARTICLES}, {_UNIQUE}, {_JSON} SELECT url, category FROM latest WHERE url IN (SELECT url FROM uniq)")
def assessment_semi_join(spark, d):
    return M.requested_only(_assessed(spark, d), _unique(spark, d)).select("url", "category")


@query(_ALL + "SELECT url, matched, category, round(sentiment, 6) AS sentiment, round(severity, 6) AS severity, round(scale, 6) AS scale, round(confidence, 6) AS confidence, duration_hours FROM scored")
def score_with_fallback(spark, d):
    r = [F.round(c, 6).alias(c) for c in ("sentiment", "severity", "scale", "confidence")]
    return _scored(spark, d).select("url", "matched", "category", *r, "duration_hours")


# --- Events ---------------------------------------------------------------------------

_EVENT = f"event_id, headline AS title, CASE WHEN clean_excerpt <> '' THEN clean_excerpt ELSE {_text(config.NO_SUMMARY)} END AS summary, category, scope, published_at AS occurred_at, impact, current_impact"
_event_columns = ["event_id", "title", "summary", "category", "scope", "occurred_at", "score.impact", "current_impact"]


@query(_EVENTS + f"SELECT {_EVENT} FROM named")
def scored_events(spark, d):
    return _events(spark, d).select(*_event_columns)


@query(_EVENTS + "SELECT event_id, current_impact FROM named WHERE sentiment <> 0 ORDER BY abs(current_impact) DESC, pos")
def active_events(spark, d):
    return E.by_impact(E.active(_events(spark, d))).select("event_id", "current_impact")


@query(_EVENTS + "SELECT event_id, headline AS title, category, current_impact FROM named WHERE current_impact > 0 ORDER BY current_impact DESC, event_id LIMIT 5")
def top_movers_positive(spark, d):
    return E.movers(_events(spark, d), True)


@query(_EVENTS + "SELECT event_id, headline AS title, category, current_impact FROM named WHERE current_impact < 0 ORDER BY current_impact, event_id LIMIT 5")
def top_movers_negative(spark, d):
    return E.movers(_events(spark, d), False)


@query(_EVENTS + "SELECT event_id, headline AS title, category, current_impact FROM named WHERE current_impact > 0")
def movers_unlimited(spark, d):
    return E.movers(_events(spark, d), True, None)


@query(_EVENTS + "SELECT event_id, headline AS title FROM named WHERE url = 'https://example.com/sample/3'")
def event_lookup(spark, d):
    wanted = spark.range(1).select(X.event_id(F.lit("https://example.com/sample/3")).alias("event_id"))
    return _events(spark, d).join(F.broadcast(wanted), "event_id", "left_semi").select("event_id", "title")


@query(f"SELECT * FROM ({_values([(n, h, 'rss', lang, r, b) for n, _, h, lang, r, b in config.SOURCES])}) AS t(name, homepage_url, source_type, language, reliability, bias_note)")
def sources_listing(spark, d):
    from .sources.feeds import source_catalog

    return A.source_listing(source_catalog(spark))


@query(_EVENTS + "SELECT event_id, current_impact FROM named WHERE category = 'health' AND scope = 'regional' AND published_at >= TIMESTAMP '2024-01-01' AND published_at <= TIMESTAMP '2024-01-04 12:00:00'")
def events_filtered(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = E.filtered(_events(spark, d), status="emerging", category="health", scope="regional", start=at("2024-01-01 00:00:00"), end=at("2024-01-04 12:00:00"))
    return rows.select("event_id", "current_impact")


@query(_EVENTS + "SELECT event_id, current_impact FROM named WHERE abs(current_impact) < 0.5 OR (abs(current_impact) = 0.5 AND event_id > 'rss_m') ORDER BY abs(current_impact) DESC, event_id LIMIT 25")
def events_page(spark, d):
    return E.page(_events(spark, d), 25, (0.5, "rss_m")).select("event_id", "current_impact")


@query(_EVENTS + "SELECT event_id, url AS first_source_url FROM named")
def first_source_urls(spark, d):
    return _events(spark, d).select("event_id", E.first_source_url().alias("first_source_url"))


@query(_EVENTS + "SELECT category, round(sum(CASE WHEN current_impact > 0 THEN current_impact ELSE 0 END), 2) AS positive_sum, round(sum(CASE WHEN current_impact < 0 THEN current_impact ELSE 0 END), 2) AS negative_sum, count(*) AS active_events FROM named WHERE sentiment <> 0 GROUP BY category")
def category_balance(spark, d):
    return I.category_balance(E.active(_events(spark, d)))


@query(_EVENTS + "SELECT scope, round(1000 + sum(current_impact), 2) AS current_index, count(*) AS active_events FROM named WHERE sentiment <> 0 GROUP BY ROLLUP (scope)")
def regional_index(spark, d):
    return I.scope_index(E.active(_events(spark, d)))


_CLUSTERS = f"""
WITH {_ARTICLES}, keyed AS (SELECT *, CASE WHEN {_key('headline')} <> '' THEN {_key('headline')} ELSE 'url:' || url END AS event_key FROM articles),
firsts AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY reliability DESC, published_at, url) AS rn FROM keyed),
clustered AS (SELECT f.*, CASE WHEN f.rn = 1 THEN 'primary' WHEN f.publisher = p.publisher THEN 'duplicate' ELSE 'supporting' END AS relation_type FROM firsts f JOIN firsts p ON f.event_key = p.event_key AND p.rn = 1) """


@query(_CLUSTERS + "SELECT url, event_key, relation_type FROM clustered")
def event_clusters(spark, d):
    return E.cluster(data.articles(spark, d)).select("url", "event_key", "relation_type")


@query(_CLUSTERS + f""", counted AS (SELECT event_key, count(DISTINCT publisher) AS source_count, count(*) AS articles, max(published_at) AS last_at FROM clustered GROUP BY event_key)
SELECT event_key, source_count, articles, CASE WHEN (epoch_us({_NOW}) - epoch_us(last_at)) / 3.6e9 > 336 THEN 'resolved' WHEN articles > source_count THEN 'updated' WHEN source_count >= 2 THEN 'confirmed' ELSE 'emerging' END AS status FROM counted""")
def source_count_by_event(spark, d):
    return E.life_cycle(E.source_counts(E.cluster(data.articles(spark, d))), data.now()).select("event_key", "source_count", "articles", "status")


_word_list = lambda c: f"CASE WHEN {_key(c)} = '' THEN [] ELSE list_distinct(string_split({_key(c)}, ' ')) END"


@query(
    f"WITH {_ARTICLES}, a AS (SELECT url, {_word_list('headline')} AS w FROM articles WHERE item_ord % 2 = 1), b AS (SELECT item_ord AS event_id, {_word_list('headline')} AS w FROM articles WHERE item_ord % 2 = 0 AND source_ord >= 0), "
    "pairs AS (SELECT url, event_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity FROM a, b WHERE len(a.w) > 0 AND len(b.w) > 0), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY similarity DESC, event_id) AS rn FROM pairs WHERE similarity >= 0.5) SELECT url, event_id, round(similarity, 6) AS similarity FROM ranked WHERE rn = 1"
)
def event_matching(spark, d):
    rows = data.articles(spark, d)
    events = rows.filter("item_ord % 2 = 0 and source_ord >= 0").select(F.col("item_ord").alias("event_id"), F.col("headline").alias("title"))
    return matching.match_events(rows.filter("item_ord % 2 = 1"), events).select("url", "event_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y, %-I:%M %p') AS shown, strftime(ts, '%H:%M') AS clock FROM events")
def display_times(spark, d):
    return data.read(spark, d, "events").select("event_id", D.display(F.col("ts")).alias("shown"), D.clock(F.col("ts")).alias("clock"))


# --- The index ------------------------------------------------------------------------


@query(_HOURS + "SELECT * FROM hours")
def hourly_pressure(spark, d):
    return _hours(spark, d)


@query(_SERIES + "SELECT * FROM points")
def snapshot_series(spark, d):
    return _series(spark, d)


@query(_SERIES + "SELECT snapshot_at, current_index FROM points")
def snapshot_fold(spark, d):
    return I.snapshot_fold(_hours(spark, d))


@query(_SERIES + "SELECT snapshot_at, current_index FROM points ORDER BY snapshot_at DESC LIMIT 1")
def latest_snapshot(spark, d):
    return I.latest(_series(spark, d)).select("snapshot_at", "current_index")


@query(_SERIES + "SELECT * FROM (SELECT snapshot_at, current_index, change_since_previous FROM points ORDER BY snapshot_at DESC LIMIT 500) ORDER BY snapshot_at")
def history_tail(spark, d):
    return I.history(_series(spark, d))


@query(_SERIES + "SELECT snapshot_at, current_index FROM points WHERE snapshot_at >= TIMESTAMP '2024-01-03' AND snapshot_at <= TIMESTAMP '2024-01-10 06:00:00'")
def history_range(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return I.history_range(_series(spark, d), at("2024-01-03 00:00:00"), at("2024-01-10 06:00:00")).select("snapshot_at", "current_index")


def _history_sql(interval: str) -> str:
    return _SERIES + f"SELECT date_trunc('{interval}', snapshot_at) AS bucket, arg_max(current_index, snapshot_at) AS current_index, round(sum(change_since_previous), 2) AS change, count(*) AS points FROM points GROUP BY 1"


@query(_history_sql("hour"))
def history_interval_hour(spark, d):
    return I.history_by(_series(spark, d), "hour")


@query(_history_sql("day"))
def history_interval_day(spark, d):
    return I.history_by(_series(spark, d), "day")


@query(_history_sql("week"))
def history_interval_week(spark, d):
    return I.history_by(_series(spark, d), "week")


@query(
    f"WITH {_IMPACTS}, s AS (SELECT scope, date_trunc('day', ts) AS snapshot_at, {_sums} FROM impact_events GROUP BY 1, 2) "
    "SELECT scope, snapshot_at, floor((1000 + positive_sum + negative_sum) * 100 + 0.5) / 100 AS current_index, "
    "floor(coalesce(positive_sum + negative_sum - lag(positive_sum + negative_sum) OVER (PARTITION BY scope ORDER BY snapshot_at), 0) * 100 + 0.5) / 100 AS change_since_previous FROM s"
)
def scope_series(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    sums = data.impact_events(spark, d).groupBy("scope", day.alias("snapshot_at")).agg(*I.impact_sums())
    sums = sums.withColumns({c: F.round(c, 2) for c in ("positive_sum", "negative_sum")})
    return I.snapshot_series(sums, ["scope"]).select("scope", "snapshot_at", "current_index", "change_since_previous")


@query(
    _SERIES + "SELECT e.event_id AS id, p.current_index AS previous_index FROM events e LEFT JOIN (SELECT snapshot_at, current_index, lead(snapshot_at) OVER (ORDER BY snapshot_at) AS until FROM points) p "
    "ON e.ts > p.snapshot_at AND (p.until IS NULL OR e.ts <= p.until) WHERE e.event_type = 'error'"
)
def asof_previous_snapshot(spark, d):
    left = data.impact_events(spark, d).filter("category = 'error'").select("id", "ts")
    return I.asof_join(left, _series(spark, d), "ts", "snapshot_at", ["current_index"]).select("id", F.col("current_index").alias("previous_index"))


# --- Stored tables, imports and audits ----------------------------------------------------


def _line_id():
    """lineitem has no key of its own."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def _score_rows(spark: SparkSession, d: str) -> DataFrame:
    """A score history from lineitem: an event an order, a score a line; created_at is the ship date."""
    rows = data.read(spark, d, "lineitem")
    return rows.select(
        _line_id().alias("id"), F.col("l_orderkey").alias("event_id"), (F.col("l_discount") * 10).alias("sentiment"), (F.col("l_quantity") / 50).alias("severity"),
        F.lit(0.5).alias("scale"), F.lit(0.5).alias("novelty"), F.col("l_tax").alias("confidence"), F.col("l_extendedprice").alias("impact"), (F.col("l_returnflag") != "R").alias("is_active"), F.col("l_shipdate").alias("created_at"),
    )


_ACTIVE = "active AS (SELECT * FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS sid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) DESC) AS rn FROM lineitem WHERE l_returnflag <> 'R') WHERE rn = 1)"


@query(f"WITH {_ACTIVE} SELECT l_orderkey AS event_id, sid AS id, l_extendedprice AS impact FROM active")
def active_score_latest(spark, d):
    return E.active_scores(_score_rows(spark, d)).select("event_id", "id", "impact")


@query(
    f"""WITH {_ACTIVE}, cited AS (
        SELECT l_orderkey, array_to_string(list(s_name || ':' || p_name ORDER BY s_acctbal DESC, s_name, p_name, l_partkey), ';') AS sources
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT o_orderkey AS event_id, a.l_extendedprice AS impact, c.sources FROM orders LEFT JOIN active a ON o_orderkey = a.l_orderkey LEFT JOIN cited c ON o_orderkey = c.l_orderkey"""
)
def event_detail(spark, d):
    lines = data.read(spark, d, "lineitem")
    articles = data.read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("headline"))
    made = lines.select("l_orderkey", "l_suppkey", _line_id().alias("id"), F.col("l_partkey").alias("part")).join(articles, "part")
    made = made.select("id", F.col("l_suppkey").alias("source_id"), F.lpad(F.col("part").cast("string"), 12, "0").alias("url"), "headline")
    links = lines.select(F.col("l_orderkey").alias("event_id"), _line_id().alias("article_id"), F.lit("primary").alias("relation_type"))
    sources = data.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("reliability_score"))
    events = data.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    out = E.detail(events, _score_rows(spark, d), links, made, sources)
    listed = F.array_join(F.transform("sources", lambda s: F.concat(s["publisher"], F.lit(":"), s["headline"])), ";")
    return out.select("event_id", F.col("score.impact").alias("impact"), listed.alias("sources"))


@query(
    "SELECT l_suppkey AS snapshot_id, l_orderkey AS event_id, o_orderpriority AS category, l_extendedprice AS impact, l_quantity AS current_impact "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'"
)
def snapshot_contributors(spark, d):
    scores = _score_rows(spark, d).filter("is_active")
    links = data.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("snapshot_id"), F.col("l_orderkey").alias("event_id"), _line_id().alias("event_score_id"),
        F.col("l_quantity").alias("current_impact"), F.lit(0.0).alias("hours_since_detected"),
    )
    events = data.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("category"))
    return I.contributors(links, events, scores.drop("event_id")).select("snapshot_id", "event_id", "category", "impact", "current_impact")


@query("""
    WITH q AS (SELECT l_suppkey, l_partkey AS event_id, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1, 2),
    b AS (SELECT * FROM q WHERE l_suppkey = 1), a AS (SELECT * FROM q WHERE l_suppkey = 2)
    SELECT coalesce(b.event_id, a.event_id) AS event_id, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after, coalesce(a.v, 0) - coalesce(b.v, 0) AS change FROM b FULL JOIN a ON b.event_id = a.event_id""")
def snapshot_change_explained(spark, d):
    rows = data.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("snapshot_id"), F.col("l_partkey").alias("event_id"), F.col("l_quantity").alias("current_impact"))
    return I.explain_change(rows, "1", "2")


@query(f"""
    WITH {_ARTICLES}, offered AS (SELECT url, headline, excerpt FROM articles UNION ALL SELECT url, headline, excerpt || ' again' FROM articles WHERE item_ord % 5 = 1),
    hashed AS (SELECT url, sha256(headline || chr(10) || excerpt) AS content_hash FROM offered), stored AS (SELECT url, sha256(headline || chr(10) || excerpt) AS content_hash FROM articles WHERE url LIKE '%7'),
    by_url AS (SELECT url, content_hash, row_number() OVER (PARTITION BY url ORDER BY content_hash) AS of_url FROM hashed),
    by_content AS (SELECT url, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY url) AS of_content FROM by_url WHERE of_url = 1)
    SELECT url, content_hash FROM by_content WHERE of_content = 1 AND url NOT IN (SELECT url FROM stored) AND content_hash NOT IN (SELECT content_hash FROM stored)""")
def import_anti_duplicates(spark, d):
    rows = data.articles(spark, d)
    stored = rows.filter("url like '%7'").select("url", X.content_hash(F.concat_ws("\n", "headline", "excerpt")).alias("content_hash"))
    again = rows.filter("item_ord % 5 = 1").withColumn("excerpt", F.concat("excerpt", F.lit(" again")))
    return A.importable(rows.unionByName(again), stored).select("url", "content_hash")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 0 OR TIMESTAMP '2024-01-01' + to_minutes(c_custkey) + to_minutes(60 * (c_nationkey % 3 + 1)) <= TIMESTAMP '2024-01-01 12:00:00')")
def due_sources(spark, d):
    sources = data.read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"), (60 * (F.col("c_nationkey") % 3 + 1)).alias("fetch_interval_minutes"),
        F.when(F.col("c_nationkey") != 0, F.timestamp_micros(F.lit(1704067200000000) + F.col("c_custkey") * 60_000_000)).alias("last_fetched_at"),
    )
    return A.due_sources(sources, F.lit("2024-01-01 12:00:00").cast("timestamp")).select("id")


@query(
    f"SELECT event_id, abs(given - formula) > 0.011 AS differs FROM (SELECT event_id, {_round2('value / 100')} AS given, "
    f"{_round2(f'(value / 500) * {_double(0.5)} * {_double(0.8)} * {_double(0.9)} * {_double(0.7)} * {_double(1.1)} * least(greatest(log10(CAST(72 AS DOUBLE) + 10) / 2, 0.5), 1.5) * 10')} AS formula FROM events)"
)
def formula_tolerance_check(spark, d):
    rows = data.read(spark, d, "events").select(
        "event_id", (F.col("value") / 500).alias("sentiment"), F.lit(0.5).alias("severity"), F.lit(0.8).alias("scale"), F.lit(0.9).alias("novelty"), F.lit(0.7).alias("confidence"), F.lit(72.0).alias("duration_hours"),
        F.lit("health").alias("category"), F.lit("r").alias("rationale"), F.lit(3).alias("source_count"), N.round2(F.col("value") / 100).alias("impact"),
    )
    return rows.select("event_id", F.array_contains(S.consistency_errors(), "impact differs from the formula.").alias("differs"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(*) > 1")
def constraint_audit_unique(spark, d):
    from .sources import schemas, warehouse

    rows = data.read(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").cast("string").alias("id"), F.lit("x").alias("name"))
    found = warehouse.audit({"sources": schemas.conform(rows, "sources", data.now().cast("timestamp"))})
    return found.filter("rule = 'unique id'").select("value", "n")


@query("SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def constraint_audit_reference(spark, d):
    from .sources import schemas, warehouse

    at = data.now().cast("timestamp")
    articles = data.read(spark, d, "lineitem").select(_line_id().alias("id"), F.col("l_partkey").cast("string").alias("source_id"))
    sources = data.read(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("id"))
    found = warehouse.audit({"articles": schemas.conform(articles, "articles", at), "sources": schemas.conform(sources, "sources", at)})
    return found.filter("rule = 'source_id in sources'").select("value", "n")


# --- The whole refresh ------------------------------------------------------------------


@query(f"WITH {_ARTICLES}, {_UNIQUE.replace('uniq AS (SELECT * FROM placed WHERE rn = 1)', 'uniq AS (SELECT * FROM placed WHERE rn = 1 ORDER BY pos LIMIT 40)')}, {_FEATURES}, {_JSON}, {_SCORED} "
       "SELECT 'global' AS index_scope, round(1000 + coalesce(sum(current_impact), 0), 2) AS current_index, CAST(0 AS DOUBLE) AS change_since_previous, round(coalesce(sum(CASE WHEN current_impact > 0 THEN current_impact END), 0), 2) AS positive_impact_sum, "
       "round(coalesce(sum(CASE WHEN current_impact < 0 THEN current_impact END), 0), 2) AS negative_impact_sum, CAST(count(*) AS INT) AS active_event_count FROM scored WHERE sentiment <> 0")
def refresh_snapshot(spark, d):
    from .sources.schemas import TABLES

    run = pipeline.refresh(data.articles(spark, d), data.now(), spark.createDataFrame([], TABLES["index_snapshots"].schema), data.responses(spark, d))
    return run.snapshot.select("index_scope", "current_index", "change_since_previous", "positive_impact_sum", "negative_impact_sum", "active_event_count")


@query(f"WITH {_ARTICLES}, {_UNIQUE.replace('uniq AS (SELECT * FROM placed WHERE rn = 1)', 'uniq AS (SELECT * FROM placed WHERE rn = 1 ORDER BY pos LIMIT 40)')}, {_FEATURES}, {_NO_MODEL}, {_SCORED}, {_IDS} "
       f"SELECT {_EVENT} FROM named ORDER BY abs(current_impact) DESC, pos")
def flagship(spark, d):
    """The scored events of the newest 40 articles by keywords, neutral ones included, by absolute impact."""
    return E.by_impact(pipeline.scored(data.articles(spark, d), data.now())).select(*_event_columns)


@query(f"WITH {_IMPACTS} SELECT date_trunc('hour', ts) AS start, {_sums} FROM impact_events GROUP BY 1")
def stream_windowed_pressure(spark, d):
    """The event file read as a stream, windowed under a watermark, in update mode into a folder of Parquet by batch; the last state of each window."""
    from .sources.shared import shared_path
    from .streaming.refresh import windowed_pressure

    schema = data.read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet" if not _is_folder(spark, f"{d}/events.parquet") else "*.parquet").parquet(d if not _is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parquet")
    sign = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    impacts = stream.select(F.col("ts").cast("timestamp").alias("ts"), N.round2(sign * F.least(F.col("value") / 500, F.lit(1.0)) * 10).alias("current_impact"))
    out, state = shared_path(spark, "pressure"), shared_path(spark, "pressure-state")
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    windowed_pressure(impacts).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    last = spark.read.parquet(f"{out}/*").groupBy("start").agg(F.max_by(F.struct("positive_sum", "negative_sum", "active_events"), "batch").alias("s"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("s.positive_sum", 2).alias("positive_sum"), F.round("s.negative_sum", 2).alias("negative_sum"), "s.active_events")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def queries() -> dict[str, Query]:
    from . import served  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _SQL[name] for name in queries()}
