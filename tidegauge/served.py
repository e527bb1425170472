"""Registered queries over what the engine serves, fetches, stores and streams; files they need are first written into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from . import queries as Q
from .functions import numbers as N
from .functions import text as X
from .functions import times as D
from .operators import articles as A
from .operators import assessments as M
from .operators import events as E
from .operators import index as I
from .operators import scoring as S
from .plans import cache, pipeline, routes
from .plans import datasets as data
from .queries import query
from .sources import feeds, schemas, warehouse
from .sources.shared import shared_path

_UNIQUE_40 = Q._UNIQUE.replace("uniq AS (SELECT * FROM placed WHERE rn = 1)", "uniq AS (SELECT * FROM placed WHERE rn = 1 ORDER BY pos LIMIT 40)")
_POINTS = Q._SERIES.strip().removeprefix("WITH ")
_RUN = f"WITH {Q._ARTICLES}, {_UNIQUE_40}, {Q._FEATURES}, {Q._JSON}, {Q._SCORED}, {Q._IDS}, {_POINTS}, prior AS (SELECT * FROM points WHERE snapshot_at < {Q._NOW}), shown AS (SELECT * FROM named WHERE sentiment <> 0), " + f"""
sums AS (SELECT coalesce(sum(CASE WHEN current_impact > 0 THEN current_impact END), 0) AS p, coalesce(sum(CASE WHEN current_impact < 0 THEN current_impact END), 0) AS n, CAST(count(*) AS INT) AS events FROM shown),
last AS (SELECT current_index AS i, positive_sum + negative_sum AS pressure FROM prior ORDER BY snapshot_at DESC LIMIT 1),
made AS (SELECT {Q._NOW} AS snapshot_at, {Q._round2('i + (p + n - pressure)')} AS current_index, {Q._round2('p + n - pressure')} AS change_since_previous, round(p, 2) AS positive_impact_sum, round(n, 2) AS negative_impact_sum, events AS active_event_count FROM sums, last),
kept AS (SELECT snapshot_at, current_index, change_since_previous FROM prior UNION ALL SELECT snapshot_at, current_index, change_since_previous FROM made)
"""


def _prior(spark: SparkSession, d: str) -> DataFrame:
    """The hourly points before the run as stored snapshots."""
    rows = Q._series(spark, d).filter(F.col("snapshot_at") < data.now())
    return rows.select(
        F.lit("global").alias("index_scope"), "snapshot_at", "current_index", "change_since_previous", F.col("positive_sum").alias("positive_impact_sum"), F.col("negative_sum").alias("negative_impact_sum"),
        F.col("active_events").cast("int").alias("active_event_count"),
    )


def _run(spark: SparkSession, d: str) -> pipeline.Refresh:
    return pipeline.refresh(data.articles(spark, d), data.now(), _prior(spark, d), data.responses(spark, d))


# --- The read routes --------------------------------------------------------------------


@query(_RUN + "SELECT snapshot_at, current_index, change_since_previous, positive_impact_sum, negative_impact_sum, active_event_count FROM made")
def route_current(spark, d):
    run = _run(spark, d)
    rows = _prior(spark, d).unionByName(run.snapshot, allowMissingColumns=True)
    return routes.index_current(rows, "global").select("snapshot_at", "current_index", "change_since_previous", "positive_impact_sum", "negative_impact_sum", "active_event_count")


@query(_RUN + "SELECT * FROM (SELECT * FROM kept ORDER BY snapshot_at DESC LIMIT 500) ORDER BY snapshot_at")
def route_history(spark, d):
    return _run(spark, d).history


@query(_RUN + "SELECT date_trunc('day', snapshot_at) AS bucket, arg_max(current_index, snapshot_at) AS current_index, round(sum(change_since_previous), 2) AS change, count(*) AS points FROM kept WHERE snapshot_at >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1")
def route_history_by_day(spark, d):
    rows = _prior(spark, d).unionByName(_run(spark, d).snapshot, allowMissingColumns=True)
    return routes.index_history(rows, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), interval="day", scope="global")


@query(_RUN + "SELECT event_id, headline AS title, category, current_impact FROM shown ORDER BY abs(current_impact) DESC, pos")
def route_events(spark, d):
    return routes.events(_run(spark, d)).select("event_id", "title", "category", "current_impact")


@query(_RUN + "SELECT event_id, current_impact FROM shown WHERE scope = 'local' ORDER BY abs(current_impact) DESC, event_id LIMIT 10")
def route_events_page(spark, d):
    return routes.events(_run(spark, d), 10, scope="local").select("event_id", "current_impact")


@query(_RUN + """SELECT '{"event_id":"' || event_id || '","status":"emerging","source_count":1,"scope":"' || scope || '"}' AS value FROM shown""")
def route_events_json(spark, d):
    return routes.as_json(routes.events(_run(spark, d)).select("event_id", "status", "source_count", "scope"))


def _id_of(spark: SparkSession, url: str) -> str:
    return spark.range(1).select(X.event_id(F.lit(url))).first()[0]


@query(_RUN + "SELECT event_id, headline AS title, current_impact FROM shown ORDER BY abs(current_impact) DESC, pos LIMIT 1")
def route_event(spark, d):
    run = _run(spark, d)
    strongest = routes.events(run).select("event_id").first()
    return routes.event(run, strongest[0] if strongest else "").select("event_id", "title", "current_impact")


@query(_RUN + "SELECT i, 'event_not_found' AS code, 'Event not found.' AS message FROM (VALUES (1, 'https://example.com/sample/3'), (2, 'https://example.com/none')) AS t(i, url) WHERE url NOT IN (SELECT url FROM shown)")
def route_event_not_found(spark, d):
    run = _run(spark, d)
    asked = [routes.event_not_found(run, _id_of(spark, url)).select(F.lit(i).alias("i"), "error.*") for i, url in ((1, "https://example.com/sample/3"), (2, "https://example.com/none"))]
    return feeds.union_all(asked)


@query(_RUN + """SELECT * FROM (SELECT event_id, current_impact, 'positive' AS direction FROM shown WHERE current_impact > 0 ORDER BY current_impact DESC, event_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT event_id, current_impact, 'negative' AS direction FROM shown WHERE current_impact < 0 ORDER BY current_impact, event_id LIMIT 5)""")
def route_top_movers(spark, d):
    return routes.top_movers(_run(spark, d)).select("event_id", "current_impact", "direction")


@query(f"WITH {Q._ARTICLES} SELECT publisher, headline, url, published_at, excerpt FROM articles ORDER BY published_at DESC, source_ord, item_ord")
def route_articles(spark, d):
    return routes.articles(_run(spark, d))


_CATALOG = f"catalog AS (SELECT s_name AS name, 'https://' || lower(replace(s_name, '#', '-')) || '.example.com' AS homepage_url, n_name AS language, {Q._round2('s_acctbal / 10000')} AS reliability, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'note ' || s_suppkey END AS bias_note, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers as news sources."""
    rows = data.read(spark, d, "supplier").join(data.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    host = F.lower(F.regexp_replace("s_name", "#", "-"))
    note = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("note "), F.col("s_suppkey").cast("string")))
    return rows.select(F.col("s_name").alias("name"), F.concat(F.lit("https://"), host, F.lit(".example.com")).alias("homepage_url"), F.col("n_name").alias("language"), N.round2(F.col("s_acctbal") / 10000).alias("reliability"), note.alias("bias_note"))


@query(f"WITH {_CATALOG} SELECT name, homepage_url, 'rss' AS source_type, language, reliability, bias_note FROM catalog")
def route_sources(spark, d):
    return routes.sources(_catalog(spark, d))


@query(f"WITH {_CATALOG} SELECT name, reliability FROM catalog WHERE s_suppkey = 7")
def source_lookup_ci(spark, d):
    return A.source_named(_catalog(spark, d), "sUPPLIER#000000007").select("name", "reliability")


@query("SELECT 'source_not_found' AS code, 'Source \"x\" not found. Available: ' || string_agg(n_name, ', ' ORDER BY n_name) AS message FROM nation")
def source_not_found(spark, d):
    return A.source_not_found(data.read(spark, d, "nation").select(F.col("n_name").alias("name")), "x")


@query("SELECT s_name AS source, count(l_orderkey) AS n FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_partkey % 5 = 0) ON s_suppkey = l_suppkey WHERE s_suppkey IN (3, 5) GROUP BY 1")
def route_ingestion_counts(spark, d):
    fetched = _fetched(spark, d)
    return feeds.union_all([routes.ingestion(_catalog(spark, d), fetched, f"supplier#00000000{i}")[0] for i in (3, 5)])


@query("SELECT s_name AS publisher, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS url FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_partkey % 5 = 0")
def route_ingestion_articles(spark, d):
    return routes.ingestion(_catalog(spark, d), _fetched(spark, d))[1].select("publisher", "url")


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """Line items as fetched articles of their suppliers."""
    rows = data.read(spark, d, "lineitem").filter("l_partkey % 5 = 0").join(data.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_name").alias("publisher"), F.col("l_returnflag").alias("headline"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("url"), F.col("l_shipdate").alias("published_at"), F.lit("").alias("excerpt")
    )


@query(f"WITH {Q._ARTICLES}, {_UNIQUE_40}, {Q._FEATURES}, {Q._JSON}, {Q._SCORED} SELECT {Q._NOW} AS refreshed_at, (SELECT count(*) FROM articles) AS article_count, count(*) AS event_count FROM scored WHERE sentiment <> 0")
def route_refresh(spark, d):
    return _run(spark, d).summary()


@query(_RUN + "SELECT 1 AS refreshes_within, 2 AS refreshes_forced, count(*) AS events, (SELECT count(*) FROM kept) AS points FROM shown")
def shared_refresh(spark, d):
    """The kept refresh: a second request within its time shares it, a forced one makes another; the views show its parts."""
    made = []

    def make() -> pipeline.Refresh:
        made.append(1)
        return _run(spark, d)

    latest = cache.LatestRefresh(make, clock=lambda: 0.0)
    latest.get()
    latest.get()
    within = len(made)
    latest.get(force=True)
    names = latest.views(f"served_{abs(hash(d))}_")
    counts = spark.table(names[1]).agg(F.count("*").alias("events")).crossJoin(spark.table(names[3]).agg(F.count("*").alias("points")))
    return counts.select(F.lit(within).alias("refreshes_within"), F.lit(len(made)).alias("refreshes_forced"), "events", "points")


@query(_RUN + "SELECT snapshot_at, strftime(snapshot_at, '%H:%M') AS label, current_index AS value, round((rn - 1) / greatest(n - 1, 1) * CAST(720 AS DOUBLE), 2) AS x, "
       "round(CASE WHEN high > low THEN CAST(240 AS DOUBLE) - (current_index - low) / (high - low) * CAST(240 AS DOUBLE) ELSE 120 END, 2) AS y "
       "FROM (SELECT *, row_number() OVER (ORDER BY snapshot_at) AS rn, count(*) OVER () AS n, min(current_index) OVER () AS low, max(current_index) OVER () AS high FROM (SELECT * FROM kept ORDER BY snapshot_at DESC LIMIT 500))")
def trend_chart_points(spark, d):
    return I.chart_points(_run(spark, d).history)


@query(_RUN + """SELECT '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 720 240"><title>' || printf('%.2f', arg_max(current_index, snapshot_at)) || '</title><polyline fill="none" stroke="#246b88" points="' ||
    string_agg(printf('%.2f,%.2f', x, y), ' ' ORDER BY snapshot_at) || '"/></svg>' AS svg FROM (
    SELECT *, round((rn - 1) / greatest(n - 1, 1) * CAST(720 AS DOUBLE), 2) AS x, round(CASE WHEN high > low THEN CAST(240 AS DOUBLE) - (current_index - low) / (high - low) * CAST(240 AS DOUBLE) ELSE 120 END, 2) AS y
    FROM (SELECT *, row_number() OVER (ORDER BY snapshot_at) AS rn, count(*) OVER () AS n, min(current_index) OVER () AS low, max(current_index) OVER () AS high FROM (SELECT * FROM kept ORDER BY snapshot_at DESC LIMIT 500)))""")
def trend_chart(spark, d):
    return I.chart_svg(I.chart_points(_run(spark, d).history))


# --- Feeds --------------------------------------------------------------------------------

FEEDS = 6
_ITEMS = f"""items AS (
    SELECT c_custkey AS k, c_custkey % {FEEDS} AS feed, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'https://news.example.com/' || c_custkey END AS link,
        CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name || ' & <co>' END AS title,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01' + to_hours(c_custkey), '%a, %d %b %Y %H:%M:%S') || ' GMT' END AS date,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE '<p>' || lower(c_mktsegment) || ' <b>news</b></p>' END AS content, lower(c_mktsegment) || ' news' AS plain FROM customer
)"""


def _write_feeds(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """customer as the items of FEEDS feeds, each an XML file, besides one that is missing and one that is torn: (name, file)."""
    k = F.col("c_custkey")
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    element = lambda name, c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(f"<{name}>"), quoted(c), F.lit(f"</{name}>")))
    at = F.date_format(F.timestamp_micros(F.lit(1_704_067_200_000_000) + k * 3_600_000_000), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item>"), element("link", F.when(k % 7 != 0, F.concat(F.lit("https://news.example.com/"), k.cast("string")))), element("title", F.when(k % 11 == 0, "").otherwise(F.concat("c_name", F.lit(" & <co>")))),
        element("pubDate", F.when(k % 5 == 0, None).when(k % 3 == 0, "soon").otherwise(F.concat(at, F.lit(" GMT")))),
        element("description", F.when(k % 13 != 0, F.concat(F.lit("<p>"), F.lower("c_mktsegment"), F.lit(" <b>news</b></p>")))), F.lit("</item>"),
    )
    items = data.read(spark, d, "customer").select((k % FEEDS).alias("feed"), k.alias("k"), item.alias("value"))
    ends = [(f, at, text) for f in range(FEEDS) for at, text in ((-(1 << 63), '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>t</title>'), ((1 << 63) - 1, "</channel></rss>"))]
    folder = shared_path(spark, "feeds")
    rows = items.unionByName(spark.createDataFrame([*ends, (FEEDS, 0, "<rss><channel><item>")], "feed bigint, k bigint, value string"))
    # an item a line, so that no feed is ever one value
    rows.repartition("feed").sortWithinPartitions("feed", "k").select("feed", "value").write.partitionBy("feed").text(folder)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"feed=(\d+)", 1).cast("int").alias("feed"), "path")
    named = [(f"feed {r.feed}", r.path) for r in sorted(files.collect())]
    return [*named, ("feed gone", f"{folder}/none.xml")]


def _scan(spark: SparkSession, d: str, errors: bool = False) -> DataFrame:
    return feeds.scan_feeds(spark, _write_feeds(spark, d), errors, feeds.FeedFileDataSource)


@query(f"WITH {_ITEMS} SELECT 'feed ' || feed AS publisher, CAST(row_number() OVER (PARTITION BY feed ORDER BY k) - 1 AS INT) AS item_ord, link, title, date AS pub_date, CASE WHEN content IS NOT NULL THEN plain END AS snippet, content FROM items")
def feed_scan(spark, d):
    return _scan(spark, d).select("publisher", "item_ord", "link", "title", F.col("pubDate").alias("pub_date"), F.col("contentSnippet").alias("snippet"), "content")


@query(f"WITH {_ITEMS} SELECT 'feed ' || feed AS publisher, count(*) AS items, false AS failed FROM items GROUP BY 1 UNION ALL VALUES ('feed {FEEDS}', 0, true), ('feed gone', 0, true)")
def feed_health(spark, d):
    """Items of each feed, and whether it failed: a dead or torn feed costs no other."""
    return _scan(spark, d, True).groupBy("publisher").agg(F.count_if(F.col("error").isNull()).alias("items"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


_LANDED = f"{_ITEMS}, landed AS (SELECT k, link, title, date, content, plain FROM items)"


@query(f"WITH {_LANDED} SELECT link, title, date AS pub_date, CASE WHEN content IS NOT NULL THEN plain END AS snippet FROM landed")
def feed_landed(spark, d):
    files = [path for name, path in _write_feeds(spark, d) if name not in (f"feed {FEEDS}", "feed gone")]
    read = feeds.union_all([feeds.read_items(spark, "rss", f) for f in files])
    return read.select("link", "title", F.col("pubDate").alias("pub_date"), F.col("contentSnippet").alias("snippet"))


@query(f"WITH {_ITEMS} SELECT 'feed ' || feed AS publisher, link AS url, title AS headline, CASE WHEN date LIKE '%GMT' THEN TIMESTAMP '2024-01-01' + to_hours(k) ELSE {Q._NOW} END AS published_at, CASE WHEN content IS NULL THEN '' ELSE plain END AS excerpt FROM items WHERE link IS NOT NULL AND title <> ''")
def feed_articles(spark, d):
    """Items as articles: without link or title none; the run's time where the date is missing or can't be read."""
    scanned = _scan(spark, d)
    halves = feeds.union_all([scanned.filter("source_ord % 2 = 0"), scanned.filter("source_ord % 2 = 1")])
    rows = feeds.items_to_articles(halves, data.now().cast("timestamp"))
    return rows.select("publisher", "url", "headline", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "excerpt")


_ENTERED = "SELECT 'https://x.example/' || p_partkey AS link, p_name || ', \"' || p_brand || '\"' AS title, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type || chr(10) || 'line two' END AS content, p_size FROM part"


def _entered(spark: SparkSession, d: str) -> DataFrame:
    p = data.read(spark, d, "part")
    return p.select(
        F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("link"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("title"), F.lit(None).cast("string").alias("pubDate"),
        F.lit(None).cast("string").alias("contentSnippet"), F.when(F.col("p_size") % 4 != 0, F.concat("p_type", F.lit("\nline two"))).alias("content"),
    )


@query(f"SELECT link, title, content FROM ({_ENTERED})")
def items_from_api(spark, d):
    path = shared_path(spark, "api")
    _entered(spark, d).write.json(path)
    spark.createDataFrame([("not json {",)], "value string").write.mode("append").text(path)
    return feeds.read_items(spark, "api", path).filter("link is not null").select("link", "title", "content")


@query(f"SELECT link, title, content FROM ({_ENTERED})")
def items_by_hand(spark, d):
    path = shared_path(spark, "manual")
    _entered(spark, d).write.csv(path, header=True, escape='"', emptyValue="")
    return feeds.read_items(spark, "manual", path).select("link", "title", "content")


# --- Models -------------------------------------------------------------------------------


@query(f"WITH {Q._ARTICLES}, {Q._UNIQUE} SELECT url, headline, {Q._strip('excerpt')} AS excerpt, publisher, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM uniq")
def model_requests(spark, d):
    """The requests as sent, read back from their JSON."""
    fields = F.from_json("request", "url string, headline string, excerpt string, publisher string, publishedAt string")
    return M.request_json(Q._unique(spark, d)).select(fields.alias("r")).select("r.url", "r.headline", "r.excerpt", "r.publisher", F.col("r.publishedAt").alias("published_at"))


def stub_model(requests: list[dict]) -> str:
    """A stand-in for a model: answers by the length of the url, and fails for every tenth article."""
    import json

    if any(r["url"].endswith("3") for r in requests):
        raise TimeoutError("the model did not answer")
    names = list(config.CATEGORIES)
    answer = lambda r: {"url": r["url"], "category": names[int(r["url"][-1])] if r["url"][-1] < "9" else "weather", "sentiment": -0.5, "severity": len(r["url"]) / 100, "scale": 2, "confidence": 0.25, "durationHours": 24, "rationale": r["publisher"]}
    return json.dumps({"assessments": [answer(r) for r in requests]})


@query(f"WITH {Q._ARTICLES} SELECT url, list_element([{', '.join(map(Q._text, config.CATEGORIES))}], CAST(right(url, 1) AS INT) + 1) AS category, least(length(url) / 100, 1) AS severity, CAST(1 AS DOUBLE) AS scale, publisher AS rationale FROM articles WHERE right(url, 1) NOT IN ('3', '9')")
def model_answers(spark, d):
    """A model asked article by article: failed calls and unknown categories give no assessment, values are clamped."""
    answers = M.ask(data.articles(spark, d), stub_model, batch=1)
    return M.last_of_each(M.parse_assessments(answers)).select("url", "category", "severity", "scale", "rationale")


@query(Q._EVENTS + f"SELECT event_id, {Q._text(config.NO_LOCATION)} AS location_name, 'emerging' AS status, 1 AS source_count, {Q._text(config.SCORING_VERSION)} AS scoring_version, CAST(10 AS DOUBLE) AS impact_multiplier, published_at AS detected_at FROM named")
def event_constants(spark, d):
    return Q._events(spark, d).select("event_id", "location_name", "status", "source_count", "score.scoring_version", "score.impact_multiplier", "detected_at")


# --- Stored tables ------------------------------------------------------------------------


@query(_RUN + "SELECT snapshot_at, current_index, 'global' AS index_scope, CAST(1000 AS DOUBLE) AS baseline FROM points")
def stored_snapshots(spark, d):
    """Snapshots appended in three overlapping parts and read again: what is stored isn't stored twice, defaults are filled in."""
    root, at = shared_path(spark, "warehouse"), data.now().cast("timestamp")
    rows = Q._series(spark, d).select(X.named_uuid(F.col("snapshot_at").cast("string")).alias("id"), F.col("snapshot_at").cast("timestamp").alias("snapshot_at"), "current_index", F.lit(config.CALCULATION_VERSION).alias("calculation_version"))
    day = F.dayofmonth("snapshot_at")
    for part in (rows.filter(day <= 12), rows.filter((day > 8) & (day <= 20)), rows):
        warehouse.append(part, root, "index_snapshots", at)
    return warehouse.read(spark, root, "index_snapshots").select(F.col("snapshot_at").cast("timestamp_ntz").alias("snapshot_at"), "current_index", "index_scope", "baseline")


@query(_RUN + "SELECT current_index, change_since_previous FROM made")
def state_across_runs(spark, d):
    """The previous snapshot comes from the stored table, as in a run that starts anew."""
    root = shared_path(spark, "warehouse")
    stored = _prior(spark, d).withColumns({"id": X.named_uuid(F.col("snapshot_at").cast("string")), "snapshot_at": F.col("snapshot_at").cast("timestamp"), "calculation_version": F.lit("v")})
    warehouse.append(stored, root, "index_snapshots", data.now().cast("timestamp"))
    run = pipeline.refresh(data.articles(spark, d), data.now().cast("timestamp"), warehouse.read(spark, root, "index_snapshots"), data.responses(spark, d))
    return run.snapshot.select("current_index", "change_since_previous")


@query("SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr(h, 17, 1) AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT event_id, md5('event ' || event_id) AS h FROM events)")
def named_keys(spark, d):
    return data.read(spark, d, "events").select("event_id", X.named_uuid(F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("id"))


@query("SELECT count(*) AS rows, count(*) AS keys, count(*) AS well_formed FROM events")
def random_keys(spark, d):
    keys = data.read(spark, d, "events").select(X.random_uuid().alias("id"))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    per_key = keys.groupBy("id").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("id").rlike(form)).alias("well_formed"))


@query(f"SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'rss' ELSE c_mktsegment END AS source_type, CAST(0.5 AS DOUBLE) AS reliability_score, 60 AS fetch_interval_minutes, c_acctbal > 0 OR c_custkey % 4 = 0 AS is_active, {Q._NOW} AS created_at FROM customer")
def stored_defaults(spark, d):
    k = F.col("c_custkey")
    rows = data.read(spark, d, "customer").select(k.cast("string").alias("id"), F.when(k % 2 != 0, F.col("c_mktsegment")).alias("source_type"), F.when(k % 4 != 0, F.col("c_acctbal") > 0).alias("is_active"), k.alias("surplus"))
    out = schemas.conform(rows, "sources", data.now().cast("timestamp"))
    return out.select(F.col("id").cast("bigint").alias("k"), "source_type", "reliability_score", "fetch_interval_minutes", "is_active", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT 's' || l_suppkey || '/' || l_orderkey AS id, l_suppkey, l_orderkey AS event_id, sid AS event_score_id, l_quantity AS current_impact FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS sid FROM lineitem WHERE l_returnflag <> 'R')")
def contributor_rows(spark, d):
    lines = data.read(spark, d, "lineitem").filter("l_returnflag <> 'R'").withColumn("sid", Q._line_id())
    # a line's event and score are its order and itself, so that both sides meet one to one
    events = lines.select(F.col("sid").alias("event_id"), F.col("l_quantity").alias("current_impact"), F.lit(0.0).alias("age_hours"), "l_suppkey", "l_orderkey")
    scores = data.read(spark, d, "lineitem").select(Q._line_id().alias("id"), Q._line_id().alias("event_id"), (F.col("l_returnflag") != "R").alias("is_active"))
    snapshot = F.concat(F.lit("s"), F.split("event_id", "-")[3])
    rows = I.contributor_rows(events.drop("l_suppkey", "l_orderkey"), scores, snapshot)
    order = F.split("event_id", "-")[0].cast("bigint")
    return rows.select(F.concat_ws("/", "snapshot_id", order.cast("string")).alias("id"), F.expr("bigint(substring(snapshot_id, 2))").alias("l_suppkey"), order.alias("event_id"), "event_score_id", "current_impact")


# --- Articles and scores over time ----------------------------------------------------------


_ORDER_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'failed' ELSE 'processed' END"


def _stored_articles(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "failed").otherwise("processed")
    return data.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit(None).cast("string").alias("failure_reason"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN {_ORDER_STATUS} WHEN l.duplicate IS NULL THEN 'ignored' WHEN l.duplicate THEN 'duplicate' ELSE 'processed' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag = 'R') AS duplicate FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) l ON o_orderkey = l_orderkey""")
def articles_settled(spark, d):
    links = data.read(spark, d, "lineitem").filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("article_id"), F.when(F.col("l_returnflag") == "R", "duplicate").otherwise("supporting").alias("relation_type"))
    return A.settle(_stored_articles(spark, d), links).select("id", "status")


@query(f"""SELECT o_orderkey AS id, CASE WHEN r.reason IS NULL THEN {_ORDER_STATUS} ELSE 'failed' END AS status, r.reason AS failure_reason FROM orders LEFT JOIN
    (SELECT l_orderkey, string_agg(DISTINCT 'line ' || l_linenumber, '; ' ORDER BY 'line ' || l_linenumber) AS reason FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) r ON o_orderkey = l_orderkey""")
def articles_failed(spark, d):
    failures = data.read(spark, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason"))
    return A.mark_failed(_stored_articles(spark, d), failures).select("id", "status", "failure_reason")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - to_hours(48)")
def articles_stale(spark, d):
    return A.stale_articles(_stored_articles(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp"), 48).select("id")


@query(Q._KEYWORDS + "SELECT url FROM features WHERE negative_hits + positive_hits >= 2")
def event_candidates(spark, d):
    return E.candidates(Q._features(spark, d), 2).select("url")


@query(Q._EVENTS + "SELECT event_id, published_at AS occurred_at FROM named ORDER BY published_at, event_id")
def event_timeline(spark, d):
    return E.timeline(Q._events(spark, d)).select("event_id", "occurred_at")


@query("""WITH history AS (SELECT l_orderkey AS event_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, l_shipdate AS made FROM lineitem UNION ALL
    SELECT o_orderkey, 'new', TIMESTAMP '1997-06-01' FROM orders WHERE o_custkey % 2 = 0)
    SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY made DESC, id DESC) = 1 AS is_active FROM history""")
def scores_renewed(spark, d):
    new = data.read(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.lit("new").alias("id"), F.col("o_orderkey").alias("event_id"), F.lit("1997-06-01").cast("timestamp_ntz").alias("created_at"))
    return S.rescore(Q._score_rows(spark, d).select("id", "event_id", "created_at"), new).select("event_id", "id", "is_active")


_FORMULA = Q._round2("sentiment * severity * CAST(0.5 AS DOUBLE) * CAST(0.8 AS DOUBLE) * confidence * CAST(1.1 AS DOUBLE) * least(greatest(log10(CAST(72 AS DOUBLE) + 10) / 2, 0.5), 1.5) * 10")


@query(f"""SELECT event_id, is_active, {_FORMULA} AS impact FROM (SELECT event_id, event_id % 4 <> 1 AS is_active, CASE WHEN event_id % 3 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE value / 500 END AS sentiment,
    CASE WHEN event_id % 6 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS severity, CAST(0.6 AS DOUBLE) AS confidence FROM events)""")
def scores_overridden(spark, d):
    e = data.read(spark, d, "events")
    scores = e.select(
        "event_id", (F.col("value") / 500).alias("sentiment"), F.lit(0.3).alias("severity"), F.lit(0.5).alias("scale"), F.lit(0.8).alias("novelty"), F.lit(0.6).alias("confidence"), F.lit(72.0).alias("duration_hours"),
        F.lit("health").alias("category"), F.lit(True).alias("is_active"), F.lit(0.0).alias("impact"),
    )
    k = F.col("event_id")
    overrides = e.filter((k % 3 == 0) | (k % 4 == 1)).select(k, F.when(k % 3 == 0, -0.5).alias("sentiment"), F.when(k % 6 == 0, 0.9).alias("severity"), (k % 4 == 1).alias("disabled"))
    return S.apply_overrides(scores, overrides).select("event_id", "is_active", "impact")


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 3 = 0 THEN 'category' END, CASE WHEN event_type = 'error' THEN 'rationale' END, CASE WHEN value > 400 THEN 'severity' END], lambda m: m IS NOT NULL), ' ') AS missing FROM events")
def fields_missing(spark, d):
    rows = data.read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, "x").alias("category"), F.when(F.col("event_type") != "error", "x").alias("rationale"), F.when(F.col("value") <= 400, 1.0).alias("severity"))
    return rows.select("event_id", F.array_join(S.missing_fields(("category", "rationale", "severity")), " ").alias("missing"))


@query(f"""SELECT user_id AS event_id, {Q._round2(f"arg_min(value, ts) * exp(-(1 / {Q._double(72)}) * greatest((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(max(ts))) / {Q._double(3.6e9)}, 0))")} AS current_impact FROM events GROUP BY 1""")
def impact_reinforced(spark, d):
    e = data.read(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("ts").alias("at"), "value")
    first = e.groupBy("event_id").agg(F.min_by("value", "at").alias("impact")).withColumn("decay_rate", N.decay_rate(F.lit(72.0)))
    return E.reinforced(first, e, F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")).select("event_id", "current_impact")


@query(Q._CLUSTERS + ", counted AS (SELECT event_key, count(DISTINCT publisher) AS n FROM clustered GROUP BY event_key) SELECT url, round(1 - (1 - reliability) / pow(2, n - 1), 9) AS confidence FROM clustered c JOIN counted USING (event_key)")
def confidence_backed(spark, d):
    clustered = E.cluster(data.articles(spark, d))
    counts = E.source_counts(clustered).select("event_key", "source_count")
    return clustered.join(counts, "event_key").select("url", F.round(E.backed_confidence(F.col("reliability"), F.col("source_count")), 9).alias("confidence"))


# --- Streams ------------------------------------------------------------------------------


def _half(k: int) -> str:
    articles = Q._ARTICLES.replace("\narticles AS (", "\nall_articles AS (", 1) + f", articles AS (SELECT * FROM all_articles WHERE item_ord % 2 = {k})"
    return (
        f"(WITH {articles}, {Q._UNIQUE}, {Q._FEATURES}, {Q._NO_MODEL}, {Q._SCORED} SELECT coalesce(sum(CASE WHEN current_impact > 0 THEN current_impact END), 0) AS p, "
        f"coalesce(sum(CASE WHEN current_impact < 0 THEN current_impact END), 0) AS n, CAST(count(*) AS INT) AS events FROM scored WHERE sentiment <> 0)"
    )


@query(f"""SELECT '0' AS id, {Q._round2('1000 + p + n')} AS current_index, CAST(0 AS DOUBLE) AS change_since_previous, events AS active_event_count FROM {_half(0)}
    UNION ALL SELECT '2', {Q._round2('1000 + b.p + b.n')}, {Q._round2('(b.p + b.n) - (a.p + a.n)')}, b.events FROM {_half(0)} a, {_half(1)} b""")
def stream_refresh(spark, d):
    """Three batches of articles through the periodic refresh; the second one fails, is logged and leaves no snapshot."""
    from .streaming.refresh import refresh_writer

    landed, root, state = (shared_path(spark, x) for x in ("articles", "warehouse", "state"))

    def now_of(number: int):
        if number == 1:
            raise RuntimeError("the clock of batch 1 is broken")
        return F.lit(data.NOW).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(number / 1e6).cast("decimal(18,6)"))

    rows = data.articles(spark, d)
    for k in (0, 0, 1):
        rows.filter(F.col("item_ord") % 2 == k).withColumn("published_at", F.col("published_at").cast("timestamp")).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
        refresh_writer(stream, root, now_of, limit=None).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return warehouse.read(spark, root, "index_snapshots").select("id", "current_index", "change_since_previous", "active_event_count")


@query(f"WITH {Q._ARTICLES} SELECT DISTINCT {Q._key('headline')} AS headline_key FROM articles")
def stream_first_by_headline(spark, d):
    """Articles read as a stream, one of each headline key."""
    from .streaming.refresh import first_by_headline

    landed, out, state = (shared_path(spark, x) for x in ("articles", "first", "state"))
    data.articles(spark, d).withColumn("published_at", F.col("published_at").cast("timestamp")).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    first_by_headline(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("headline_key")


@query(f"WITH {Q._IMPACTS} SELECT scope, round(1000 + sum(current_impact), 2) AS current_index, round(sum(current_impact), 2) AS change_since_previous, count(*) AS events FROM impact_events GROUP BY 1")
def stream_running_index(spark, d):
    """The impacts as a stream into an index of each scope with its pressure as state."""
    from .streaming.refresh import running_index

    landed, out, state = (shared_path(spark, x) for x in ("impacts", "index", "state"))
    data.impact_events(spark, d).select("scope", "current_impact").write.parquet(landed)
    stream = spark.readStream.schema("scope string, current_impact double").parquet(landed)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    running_index(stream).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{out}/*")
