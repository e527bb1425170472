"""Events: active ones, movers, lookup, filters, pages, clusters, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numbers import current_impact, round2
from ..functions.text import headline_key


def active(events: DataFrame) -> DataFrame:
    """Events whose sentiment isn't 0 (their impact may be)."""
    return events.filter(F.col("score.sentiment") != 0)


def by_impact(events: DataFrame) -> DataFrame:
    """By absolute impact, then place. A sort first samples its input: from the shuffled events, so that they aren't scored twice."""
    return events.repartition("event_id").orderBy(F.abs("current_impact").desc(), "pos" if "pos" in events.columns else "event_id")


def movers(events: DataFrame, positive: bool, n: int | None = config.MOVERS) -> DataFrame:
    """The strongest events of one direction; all of them without n."""
    i = F.col("current_impact")
    rows = events.filter(i > 0).orderBy(i.desc(), "event_id") if positive else events.filter(i < 0).orderBy(i.asc(), "event_id")
    rows = rows if n is None else rows.limit(n)
    return rows.select("event_id", "title", "category", "current_impact")


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    """The event of an id; of several articles with one url, the first in order."""
    return by_impact(events.filter(F.col("event_id") == event_id)).limit(1)


def filtered(
    events: DataFrame, status: str | None = None, category: str | None = None, scope: str | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    for name, value in (("status", status), ("category", category), ("scope", scope)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    if start is not None:
        events = events.filter(F.col("occurred_at") >= start)
    if end is not None:
        events = events.filter(F.col("occurred_at") <= end)
    return events


def page(events: DataFrame, limit: int, after: tuple[float, str] | None = None) -> DataFrame:
    """A page in order of absolute impact and id; after is (absolute impact, id) of the last row seen."""
    key = F.abs("current_impact")
    if after is not None:
        events = events.filter((key < after[0]) | (key == after[0]) & (F.col("event_id") > after[1]))
    return events.orderBy(key.desc(), "event_id").limit(limit)


def first_source_url(sources: str = "sources") -> Column:
    return F.get(sources, 0)["url"]


def timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("occurred_at", "event_id")


def active_scores(scores: DataFrame) -> DataFrame:
    """The newest active score of each event."""
    values = [c for c in scores.columns if c != "event_id"]
    newest = scores.filter("is_active").groupBy("event_id").agg(F.max_by(F.struct(*values), F.struct("created_at", "id")).alias("s"))
    return newest.select("event_id", "s.*")


def detail(events: DataFrame, scores: DataFrame, event_sources: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Each event with its active score and its articles with their sources, most reliable first."""
    score = active_scores(scores).select("event_id", F.struct("sentiment", "severity", "scale", "novelty", "confidence", "impact").alias("score"))
    a = articles.select(F.col("id").alias("article_id"), "source_id", "url", "headline")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("publisher"), "reliability_score")
    cited = event_sources.join(a, "article_id").join(s, "source_id")
    entry = F.struct((-F.col("reliability_score")).alias("o"), "publisher", "headline", "url", "relation_type")
    listed = cited.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("cited"))
    listed = listed.select("event_id", F.transform("cited", lambda x: F.struct(x["publisher"].alias("publisher"), x["headline"].alias("headline"), x["url"].alias("url"), x["relation_type"].alias("relation_type"))).alias("sources"))
    return events.withColumnRenamed("id", "event_id").join(score, "event_id", "left").join(listed, "event_id", "left")


def cluster(articles: DataFrame) -> DataFrame:
    """Articles grouped to events by headline key: event_key, relation_type (primary for the most reliable, duplicate for
    the same publisher again, else supporting) and the relation's confidence, the article's reliability.

    Headlines without a key don't resemble each other: each stands for itself."""
    key = headline_key(F.col("headline"))
    keyed = articles.withColumn("event_key", F.when(key != "", key).otherwise(F.concat(F.lit("url:"), F.col("url"))))
    best = keyed.groupBy("event_key").agg(F.min(F.struct((-F.col("reliability")).alias("r"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("t"), "url")).alias("b"), F.min_by("publisher", F.struct((-F.col("reliability")).alias("r"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("t"), "url")).alias("_publisher"))
    joined = keyed.join(best, "event_key")
    relation = F.when(F.col("url") == F.col("b.url"), "primary").when(F.col("publisher") == F.col("_publisher"), "duplicate").otherwise("supporting")
    return joined.select(*articles.columns, "event_key", relation.alias("relation_type"), F.col("reliability").alias("relation_confidence"))


#: Ours: no thresholds are given. Sources for "confirmed"; hours without news after which an event counts as resolved.
CONFIRMED_SOURCES, RESOLVED_HOURS = 2, 336.0


def source_counts(clustered: DataFrame) -> DataFrame:
    """event_key, source_count (different publishers), articles, contradicted, first and last time of each cluster."""
    return clustered.groupBy("event_key").agg(
        F.count_distinct("publisher").alias("source_count"), F.count("*").alias("articles"), F.bool_or(F.col("relation_type") == "contradicting").alias("contradicted"),
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


def life_cycle(counts: DataFrame, now: Column) -> DataFrame:
    """counts with the status: disputed, resolved, updated (more articles than sources), confirmed or emerging."""
    quiet = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / F.lit(3.6e9)
    status = (
        F.when(F.col("contradicted"), "disputed").when(quiet > RESOLVED_HOURS, "resolved").when(F.col("articles") > F.col("source_count"), "updated")
        .when(F.col("source_count") >= CONFIRMED_SOURCES, "confirmed").otherwise("emerging")
    )
    return counts.withColumn("status", status)


def backed_confidence(confidence: Column, source_count: Column) -> Column:
    """Ours: each further source halves the doubt, 1 - (1 - c) / 2^(n - 1)."""
    return F.lit(1.0) - (F.lit(1.0) - confidence) / F.pow(F.lit(2.0), (source_count - 1).cast("double"))


def candidates(features: DataFrame, minimum: int = 1) -> DataFrame:
    """The articles of keyword_features that look like a meaningful event."""
    return features.filter(is_candidate(F.col("negative_hits"), F.col("positive_hits"), minimum))


def reinforced(events: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """events(event_id, impact, decay_rate) with current_impact, the decay counted from the newest of updates(event_id, at).

    Ours: no formula is given. New information sets the clock back and leaves impact and rate as they are; an event
    without update isn't returned."""
    newest = updates.groupBy("event_id").agg(F.max("at").alias("last_at"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / F.lit(3.6e9)
    return events.join(newest, "event_id").withColumn("current_impact", round2(current_impact(F.col("impact"), F.col("decay_rate"), hours)))


def is_candidate(negative_hits: Column, positive_hits: Column, minimum: int = 1) -> Column:
    """Whether an article looks like a meaningful event: at least so many keyword hits."""
    return negative_hits + positive_hits >= minimum
