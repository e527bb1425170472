"""Articles become scored events: keyword features, model values where there are any, impact and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import numbers as N
from ..functions import text as X
from ..functions import times as D


def _worked_out(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row: as a generator's output, a filter above isn't pushed down with a copy of the expression for each mention."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def keyword_features(articles: DataFrame, now: Column, negative: tuple[str, ...] = config.NEGATIVE_TERMS, positive: tuple[str, ...] = config.POSITIVE_TERMS) -> DataFrame:
    """Articles with clean_excerpt, negative and positive hits, and the kw_ values of every dimension."""
    cleaned = articles.withColumn("clean_excerpt", X.strip_html(F.col("excerpt")))
    lowered = _worked_out(cleaned, F.lower(F.concat("headline", F.lit(" "), "clean_excerpt")).alias("_text"))
    text = F.col("_text")
    counted = _worked_out(lowered, X.count_terms("_text", negative).alias("negative_hits"), X.count_terms("_text", positive).alias("positive_hits"))
    hits = counted.withColumn("kw_category", X.first_category("_text"))
    p, n = F.col("positive_hits"), F.col("negative_hits")
    return hits.select(
        *articles.columns, "clean_excerpt", "negative_hits", "positive_hits", "kw_category", N.keyword_sentiment(p, n).alias("kw_sentiment"),
        N.keyword_severity(p, n, X.severity_bonus(text)).alias("kw_severity"), X.keyword_scale(text).alias("kw_scale"),
        X.has_word(text, config.LASTING_WORDS).alias("kw_lasting"), D.age_hours(F.col("published_at"), now).alias("age_hours"),
    )


def with_assessments(features: DataFrame, assessments: DataFrame | None) -> DataFrame:
    """The final dimensions: the model's where an assessment of the url exists, else the keywords'."""
    names = ("category", "sentiment", "severity", "scale", "confidence", "duration_hours", "rationale")
    if assessments is None:
        joined = features.select("*", F.lit(False).alias("matched"), *[F.lit(None).cast("double" if n not in ("category", "rationale") else "string").alias(f"m_{n}") for n in names])
    else:
        model = assessments.select("url", F.lit(True).alias("matched"), *[F.col(n).alias(f"m_{n}") for n in names])
        joined = features.join(model, "url", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    category, sentiment = F.coalesce("m_category", "kw_category"), F.coalesce("m_sentiment", "kw_sentiment")
    lasting = F.when(F.col("kw_lasting"), config.DURATION_LASTING)
    duration = lasting.when(category.isin(*config.LONG_CATEGORIES), config.DURATION_LONG).otherwise(config.DURATION_SHORT)
    return joined.select(
        *features.columns, "matched", category.alias("category"), sentiment.alias("sentiment"), F.coalesce("m_severity", "kw_severity").alias("severity"), F.coalesce("m_scale", "kw_scale").alias("scale"),
        N.novelty(F.col("age_hours")).alias("novelty"), F.when(F.col("matched"), N.clamp(F.col("m_confidence") * F.col("reliability"), 0, 1)).otherwise(F.col("reliability")).alias("confidence"),
        F.coalesce("m_duration_hours", duration).alias("duration_hours"),
        F.coalesce("m_rationale", X.keyword_rationale(sentiment, category, F.col("negative_hits"), F.col("positive_hits"))).alias("rationale"),
        F.array(F.when(F.col("matched"), config.NOTE_ASSESSED).otherwise(config.NOTE_FALLBACK)).alias("uncertainty_notes"),
    )


def with_impact(scored: DataFrame) -> DataFrame:
    """Adds weights, decay rate, impact (rounded) and the current impact decayed by age (rounded)."""
    c = F.col
    weighted = scored.select("*", N.category_weight(c("category")).alias("category_weight"), N.duration_weight(c("duration_hours")).alias("duration_weight"), N.decay_rate(c("duration_hours")).alias("decay_rate"))
    impacts = weighted.withColumn("impact", N.impact(c("sentiment"), c("severity"), c("scale"), c("novelty"), c("confidence"), c("category_weight"), c("duration_hours")))
    return impacts.withColumn("current_impact", N.round2(N.current_impact(c("impact"), c("decay_rate"), c("age_hours"))))


def source_article(excerpt: str = "clean_excerpt") -> Column:
    return F.struct("publisher", "headline", "url", "published_at", F.col(excerpt).alias("excerpt"), "reliability", "bias_note")


def to_events(scored: DataFrame) -> DataFrame:
    """Event rows with the nested score and sources; one article is one event."""
    score = F.struct(
        F.lit(config.SCORING_VERSION).alias("scoring_version"), "category", "sentiment", "severity", "scale", "novelty", "confidence", "category_weight", "duration_hours", "duration_weight",
        "decay_rate", F.lit(config.IMPACT_MULTIPLIER).alias("impact_multiplier"), "impact", "rationale", "uncertainty_notes",
    )
    place = [c for c in ("pos",) if c in scored.columns]
    return scored.select(
        X.event_id(F.col("url")).alias("event_id"), F.col("headline").alias("title"), X.summary_or_default(F.col("clean_excerpt")).alias("summary"), "category",
        F.lit(config.NO_LOCATION).alias("location_name"), N.scope_of(F.col("scale")).alias("scope"), F.col("published_at").alias("occurred_at"), F.col("published_at").alias("detected_at"),
        F.lit("emerging").alias("status"), F.lit(1).alias("source_count"), F.array(source_article()).alias("sources"), score.alias("score"), "current_impact", "age_hours", *place,
    )


def score_articles(articles: DataFrame, now: Column, assessments: DataFrame | None = None, **terms) -> DataFrame:
    return to_events(with_impact(with_assessments(keyword_features(articles, now, **terms), assessments)))


#: (column, low, high, message)
_RANGES = (("sentiment", -1, 1), ("severity", 0, 1), ("scale", 0, 1), ("novelty", 0, 1), ("confidence", 0, 1))


def validation_errors() -> Column:
    """Messages of the rules that a score row breaks; an empty array for a valid one."""
    found = [F.when(~N.is_between(F.col(c), lo, hi), F.lit(f"{c} must be between {lo} and {hi}.")) for c, lo, hi in _RANGES]
    found.append(F.when(F.col("duration_hours") <= 0, F.lit("duration_hours must be positive.")))
    found.append(F.when(F.coalesce(F.trim("rationale"), F.lit("")) == "", F.lit("rationale is required.")))
    return F.array_compact(F.array(*found))


def missing_fields(names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


#: Ours: no figures are given for these rules. Confidence above CONFIDENT with fewer than MIN_SOURCES sources is suspicious.
CONFIDENT, MIN_SOURCES, TOLERANCE = 0.9, 2, 0.011


def consistency_errors() -> Column:
    """Further checks of a score row with source_count: known category, impact as by the formula, confidence backed by sources, rationale against sentiment."""
    c = F.col
    expected = N.impact(c("sentiment"), c("severity"), c("scale"), c("novelty"), c("confidence"), N.category_weight(c("category")), c("duration_hours"))
    against = (c("sentiment") > 0) & c("rationale").rlike(r"(?i)\bnegative\b") | (c("sentiment") < 0) & c("rationale").rlike(r"(?i)\bpositive\b")
    found = [
        F.when(~c("category").isin(*config.CATEGORIES), F.lit("unsupported category.")), F.when(F.abs(c("impact") - expected) > TOLERANCE, F.lit("impact differs from the formula.")),
        F.when((c("confidence") > CONFIDENT) & (c("source_count") < MIN_SOURCES), F.lit("high confidence with few sources.")), F.when(against, F.lit("rationale contradicts sentiment.")),
    ]
    return F.array_compact(F.array(*found))


def apply_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scores with a reviewer's values: overrides(event_id, any of the dimensions, disabled); the impact is worked out anew."""
    dims = ("sentiment", "severity", "scale", "novelty", "confidence", "duration_hours")
    given = [d for d in dims if d in overrides.columns]
    named = overrides.select("event_id", F.col("disabled").alias("_disabled"), *[F.col(d).alias(f"_{d}") for d in given])
    joined = scores.join(named, "event_id", "left")
    values = [F.coalesce(F.col(f"_{d}"), F.col(d)).alias(d) if d in given else F.col(d) for d in dims]
    rest = [c for c in scores.columns if c not in (*dims, "is_active", "impact")]
    out = joined.select(*rest, *values, (F.col("is_active") & ~F.coalesce("_disabled", F.lit(False))).alias("is_active"))
    c = F.col
    return out.withColumn("impact", N.impact(c("sentiment"), c("severity"), c("scale"), c("novelty"), c("confidence"), N.category_weight(c("category")), c("duration_hours")))


def rescore(history: DataFrame, new: DataFrame) -> DataFrame:
    """The score history with new scores added; of each event the newest one (by created_at, then id) is active."""
    both = history.unionByName(new, allowMissingColumns=True)
    newest = both.groupBy("event_id").agg(F.max(F.struct("created_at", "id")).alias("_last"))
    joined = both.join(newest, "event_id")
    return joined.select(*[c for c in both.columns if c != "is_active"], (F.struct("created_at", "id") == F.col("_last")).alias("is_active"))
