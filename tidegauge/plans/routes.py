"""The read queries of the public interface, one function a route; each returns a DataFrame, as_json its JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import events as E
from ..operators import index as I
from .pipeline import Refresh


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def error(df: DataFrame) -> DataFrame:
    """(code, message) rows in the shape of an error body."""
    return df.select(F.struct("code", "message").alias("error"))


def index_current(snapshots: DataFrame, scope: str | None = None) -> DataFrame:
    return I.latest(snapshots, scope)


def index_history(snapshots: DataFrame, start: Column | None = None, end: Column | None = None, interval: str | None = None, scope: str | None = None) -> DataFrame:
    rows = I.history_range(snapshots, start, end, scope)
    return I.history(rows) if interval is None else I.history_by(rows, interval).orderBy("bucket")


def events(run: Refresh, limit: int | None = None, after: tuple[float, str] | None = None, **filters) -> DataFrame:
    rows = E.filtered(run.events, **filters)
    return E.by_impact(rows) if limit is None else E.page(rows, limit, after)


def event(run: Refresh, event_id: str) -> DataFrame:
    return E.by_id(run.events, event_id)


def event_not_found(run: Refresh, event_id: str) -> DataFrame:
    """One error row if there is no such event, else none."""
    found = run.events.filter(F.col("event_id") == event_id).agg(F.count("*").alias("n"))
    return error(found.filter("n = 0").select(F.lit("event_not_found").alias("code"), F.lit("Event not found.").alias("message")))


def top_movers(run: Refresh, n: int = 5) -> DataFrame:
    up, down = E.movers(run.events, True, n), E.movers(run.events, False, n)
    return up.withColumn("direction", F.lit("positive")).unionByName(down.withColumn("direction", F.lit("negative")))


def articles(run: Refresh) -> DataFrame:
    return A.listing(run.articles)


def sources(catalog: DataFrame) -> DataFrame:
    return A.source_listing(catalog)


def ingestion(catalog: DataFrame, fetched: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of each source asked for, and its articles, before any removal of doubles; unknown names give two empty tables."""
    asked = A.source_named(catalog, source)
    rows = fetched.join(asked.select(F.col("name").alias("publisher")), "publisher", "left_semi")
    return A.counts_by_source(asked, rows), A.listing(rows)
