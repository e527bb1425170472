"""Fixed schemas of the stored tables, with defaults, keys and references. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    defaults: dict[str, str] = field(default_factory=dict)  # column -> SQL expression; :now is the run's time
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, str] = field(default_factory=dict)  # column -> table
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_STAMPS = {"created_at": ":now", "updated_at": ":now"}
TABLES: dict[str, Table] = {
    "sources": Table(
        "id string, name string, feed_url string, homepage_url string, source_type string, category string, language string, country string, reliability_score double, "
        "bias_note string, fetch_interval_minutes int, last_fetched_at timestamp, is_active boolean, created_at timestamp, updated_at timestamp",
        ("id",), {"source_type": "'rss'", "reliability_score": "0.5D", "fetch_interval_minutes": "60", "is_active": "true", **_STAMPS}, required=("id", "name", "feed_url", "language"),
    ),
    "articles": Table(
        "id string, source_id string, url string, external_id string, headline string, author string, published_at timestamp, fetched_at timestamp, language string, "
        "raw_excerpt string, raw_content string, content_hash string, status string, failure_reason string, created_at timestamp, updated_at timestamp",
        ("id",), {"fetched_at": ":now", "status": "'new'", **_STAMPS}, (("url",),), {"source_id": "sources"}, ("id", "source_id", "url", "headline", "published_at", "language"),
    ),
    "events": Table(
        "id string, title string, summary string, category string, location_name string, country string, region string, latitude double, longitude double, scope string, "
        "occurred_at timestamp, detected_at timestamp, status string, source_count int, canonical_article_id string, created_at timestamp, updated_at timestamp",
        ("id",), {"scope": "'local'", "detected_at": ":now", "status": "'emerging'", "source_count": "1", **_STAMPS}, (), {}, ("id", "title", "summary", "category", "location_name", "occurred_at"),
    ),
    "event_sources": Table(
        "id string, event_id string, article_id string, relation_type string, confidence double, created_at timestamp",
        ("id",), {"relation_type": "'primary'", "confidence": "0.5D", "created_at": ":now"}, (("event_id", "article_id"),), {"event_id": "events", "article_id": "articles"}, ("id", "event_id", "article_id"),
    ),
    "event_scores": Table(
        "id string, event_id string, scoring_version string, model_name string, sentiment double, severity double, scale double, novelty double, confidence double, category_weight double, "
        "duration_weight double, impact_multiplier double, duration_hours double, decay_rate double, impact double, rationale string, uncertainty_notes string, raw_agent_output string, "
        "is_active boolean, created_at timestamp",
        ("id",), {"is_active": "true", "created_at": ":now"}, (), {"event_id": "events"},
        ("id", "event_id", "scoring_version", "sentiment", "severity", "scale", "novelty", "confidence", "category_weight", "duration_weight", "impact_multiplier", "duration_hours", "decay_rate", "impact", "rationale"),
    ),
    "index_snapshots": Table(
        "id string, snapshot_at timestamp, index_scope string, baseline double, current_index double, change_since_previous double, positive_impact_sum double, "
        "negative_impact_sum double, active_event_count int, calculation_version string, created_at timestamp",
        ("id",),
        {"index_scope": "'global'", "baseline": "1000D", "change_since_previous": "0D", "positive_impact_sum": "0D", "negative_impact_sum": "0D", "active_event_count": "0", "created_at": ":now"},
        (("snapshot_at", "index_scope"),), {}, ("id", "snapshot_at", "current_index", "calculation_version"),
    ),
    "index_snapshot_events": Table(
        "id string, snapshot_id string, event_id string, event_score_id string, current_impact double, hours_since_detected double, created_at timestamp",
        ("id",), {"created_at": ":now"}, (), {"snapshot_id": "index_snapshots", "event_id": "events", "event_score_id": "event_scores"}, ("id", "snapshot_id", "event_id", "event_score_id", "current_impact", "hours_since_detected"),
    ),
}

FEED_ITEM = "link string, title string, pubDate string, contentSnippet string, content string"
ARTICLE = "publisher string, homepage_url string, language string, reliability double, bias_note string, url string, headline string, published_at timestamp, excerpt string, source_ord bigint, item_ord bigint"


def conform(df: DataFrame, table: str, now: Column) -> DataFrame:
    """The table's columns in order and type; missing or null ones get their defaults, surplus ones are dropped."""
    spec, have, out = TABLES[table], set(df.columns), []
    for f in spec.schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        if f.name in spec.defaults:
            default = spec.defaults[f.name]
            c = F.coalesce(c.cast(f.dataType), (now if default == ":now" else F.expr(default)).cast(f.dataType))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)
