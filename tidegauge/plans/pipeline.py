"""The refresh: articles, assessments and the previous snapshots give events, the new snapshot and the history, all lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators import articles as A
from ..operators import assessments as M
from ..operators import events as E
from ..operators import index as I
from ..operators import scoring as S


@dataclass(frozen=True)
class Refresh:
    articles: DataFrame
    events: DataFrame
    snapshot: DataFrame
    history: DataFrame

    def summary(self) -> DataFrame:
        """refreshed_at, article_count, event_count."""
        n, m = self.articles.agg(F.count("*").alias("article_count")), self.events.agg(F.count("*").alias("event_count"))
        return self.snapshot.select(F.col("snapshot_at").alias("refreshed_at")).crossJoin(n).crossJoin(m)


def scored(articles: DataFrame, now: Column, responses: DataFrame | None = None, limit: int | None = config.MAX_ARTICLES, **terms) -> DataFrame:
    """Deduplicated (and limited) articles as scored events, neutral ones included."""
    unique = A.deduplicate(articles)
    if limit is not None:
        unique = A.first_articles(unique, min(limit, config.MAX_DEDUPLICATED))
    assessments = None if responses is None else M.last_of_each(M.requested_only(M.parse_assessments(responses), unique))
    return S.score_articles(unique, now, assessments, **terms)


def refresh(articles: DataFrame, now: Column, previous: DataFrame, responses: DataFrame | None = None, limit: int | None = config.MAX_ARTICLES, **terms) -> Refresh:
    events = E.active(scored(articles, now, responses, limit, **terms))
    snapshot = I.snapshot(events, previous, now)
    return Refresh(A.newest_first(articles), E.by_impact(events), snapshot, I.history(previous.unionByName(snapshot, allowMissingColumns=True)))
