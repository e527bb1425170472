"""Articles: order, removal of doubles, limits, counts, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import content_hash, headline_key


def newest_first(articles: DataFrame) -> DataFrame:
    """Newest first; ties by place in the source list, then in the feed."""
    return articles.orderBy(F.desc("published_at"), "source_ord", "item_ord")


def deduplicate(articles: DataFrame) -> DataFrame:
    """One article for each headline key, with pos, the place of the key's first article in newest-first order.

    The payload is that of the most reliable article, the first in order among equals; both
    come from one aggregation with partial combining, no global ranking."""
    order = [(-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("t"), F.col("source_ord").alias("s"), F.col("item_ord").alias("i")]
    payload = F.struct(*articles.columns)
    best = F.struct((-F.col("reliability")).alias("r"), *order)
    grouped = articles.groupBy(headline_key(F.col("headline")).alias("headline_key")).agg(F.min(F.struct(*order)).alias("pos"), F.min_by(payload, best).alias("a"))
    return grouped.select("headline_key", "pos", "a.*")


def first_articles(deduplicated: DataFrame, n: int = config.MAX_ARTICLES) -> DataFrame:
    return deduplicated.orderBy("pos").limit(n)


def counts_by_source(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """(source, n) with sources that have none."""
    n = articles.groupBy(F.col("publisher").alias("source")).agg(F.count("*").alias("n"))
    return sources.select(F.col("name").alias("source")).join(n, "source", "left").select("source", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def listing(articles: DataFrame) -> DataFrame:
    return articles.select("publisher", "headline", "url", "published_at", "excerpt")


def source_listing(sources: DataFrame) -> DataFrame:
    return sources.select("name", "homepage_url", F.lit("rss").alias("source_type"), "language", "reliability", "bias_note")


def source_named(sources: DataFrame, name: str | None) -> DataFrame:
    """Sources of a name whatever its case; all for a blank one."""
    return sources.filter(F.lower("name") == F.lower(F.lit(name))) if name else sources


def source_not_found(sources: DataFrame, name: str) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_list("name")), ", ")
    return sources.agg(F.lit("source_not_found").alias("code"), F.concat(F.lit(f'Source "{name}" not found. Available: '), names).alias("message"))


def importable(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates (url, headline, excerpt, ...) whose url and content are stored neither yet nor twice among themselves.

    Of several candidates with one url the one of the least content hash stays; then, of equal contents, the least url."""
    hashed = candidates.withColumn("content_hash", content_hash(F.concat_ws("\n", "headline", "excerpt")))
    by_url = hashed.groupBy("url").agg(F.min_by(F.struct(*[c for c in hashed.columns if c != "url"]), "content_hash").alias("a")).select("url", "a.*")
    one = by_url.groupBy("content_hash").agg(F.min_by(F.struct(*candidates.columns), "url").alias("a")).select("content_hash", "a.*")
    return one.join(stored.select("url"), "url", "left_anti").join(stored.select("content_hash"), "content_hash", "left_anti")


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Active sources whose interval since the last fetch is over, or that were never fetched."""
    next_fetch = F.unix_micros("last_fetched_at") + F.col("fetch_interval_minutes").cast("bigint") * F.lit(60_000_000)
    return sources.filter(F.col("is_active") & (F.col("last_fetched_at").isNull() | (next_fetch <= F.unix_micros(now))))


def settle(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles with the status that links(article_id, relation_type) to events give the new ones: duplicate if every
    link says so, processed if one doesn't, ignored without any. Statuses other than new stay."""
    linked = links.groupBy(F.col("article_id").alias("_article")).agg(F.bool_and(F.col("relation_type") == "duplicate").alias("_duplicate"))
    joined = articles.join(linked, articles["id"] == F.col("_article"), "left")
    settled = F.when(F.col("_article").isNull(), "ignored").when(F.col("_duplicate"), "duplicate").otherwise("processed")
    keep = [c for c in articles.columns if c != "status"]
    return joined.select(*keep, F.when(F.col("status") == "new", settled).otherwise(F.col("status")).alias("status"))


def stale_articles(articles: DataFrame, now: Column, hours: float) -> DataFrame:
    """New articles that nothing has happened to for so many hours."""
    return articles.filter((F.col("status") == "new") & (F.unix_micros("updated_at") < F.unix_micros(now) - F.lit(int(hours * 3.6e9))))


def mark_failed(articles: DataFrame, failures: DataFrame) -> DataFrame:
    """Articles with status failed and the reason where failures(id, reason) names them; several reasons of one are joined."""
    reasons = failures.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("_reason"))
    joined = articles.join(reasons, "id", "left")
    keep = [c for c in articles.columns if c not in ("status", "failure_reason")]
    return joined.select(*keep, F.when(F.col("_reason").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), F.coalesce("_reason", "failure_reason").alias("failure_reason"))
