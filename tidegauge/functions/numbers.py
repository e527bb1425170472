"""Numeric column functions of the scoring model. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null and NaN stay as they are."""
    bounded = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(bounded)


def round2(x: Column) -> Column:
    """Two decimals, halves toward plus infinity."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def is_between(x: Column, low: float, high: float) -> Column:
    """Finite and within [low, high]; false for null."""
    return F.coalesce(~F.isnan(x) & (x >= F.lit(float(low))) & (x <= F.lit(float(high))), F.lit(False))


def duration_weight(hours: Column) -> Column:
    return clamp(F.log10(hours + F.lit(10.0)) / F.lit(2.0), 0.5, 1.5)


def decay_rate(hours: Column) -> Column:
    return F.lit(1.0) / F.greatest(hours, F.lit(1.0))


def current_impact(impact: Column, rate: Column, hours_since: Column) -> Column:
    """Impact after exponential decay, unrounded; negative ages count as 0."""
    return impact * F.exp(-rate * F.greatest(hours_since, F.lit(0.0)))


def category_weight(category: Column) -> Column:
    weights = ", ".join(f"'{name}', {weight}D" for name, weight in config.CATEGORY_WEIGHTS.items())
    return F.expr(f"map({weights})")[category]


def impact(sentiment: Column, severity: Column, scale: Column, novelty: Column, confidence: Column, weight: Column, hours: Column) -> Column:
    """Rounded impact: the product of the dimensions, the category's and the duration's weight, and the multiplier, in this order."""
    return round2(sentiment * severity * scale * novelty * confidence * weight * duration_weight(hours) * F.lit(config.IMPACT_MULTIPLIER))


def novelty(age_hours: Column) -> Column:
    return clamp(F.lit(1.0) - age_hours / F.lit(config.NOVELTY_HOURS), 0.2, 0.95)


def keyword_sentiment(positive: Column, negative: Column) -> Column:
    return clamp((positive - negative).cast("double") / F.greatest(positive + negative, F.lit(1)).cast("double"), -1, 1)


def keyword_severity(positive: Column, negative: Column, bonus: Column) -> Column:
    return clamp(F.lit(0.25) + F.greatest(positive, negative).cast("double") * F.lit(0.13) + bonus, 0.2, 0.95)


def scope_of(scale: Column) -> Column:
    return F.when(scale >= 0.8, "global").when(scale >= 0.55, "regional").otherwise("local")


def signed(x: Column) -> Column:
    """Two decimals with a sign; zero is positive."""
    return F.format_string("%+.2f", x)
