"""SQL-callable forms of the scoring formulas, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "tg_round2(x DOUBLE) RETURNS DOUBLE": "floor(x * 100D + 0.5D) / 100D",
    "tg_duration_weight(hours DOUBLE) RETURNS DOUBLE": "least(greatest(log10(hours + 10D) / 2D, 0.5D), 1.5D)",
    "tg_decay_rate(hours DOUBLE) RETURNS DOUBLE": "1D / greatest(hours, 1D)",
    "tg_current_impact(impact DOUBLE, rate DOUBLE, age DOUBLE) RETURNS DOUBLE": "impact * exp(-rate * greatest(age, 0D))",
    "tg_novelty(age DOUBLE) RETURNS DOUBLE": "least(greatest(1D - age / 168D, 0.2D), 0.95D)",
    "tg_scope(scale DOUBLE) RETURNS STRING": "CASE WHEN scale >= 0.8D THEN 'global' WHEN scale >= 0.55D THEN 'regional' ELSE 'local' END",
    "tg_headline_key(h STRING) RETURNS STRING": "trim(regexp_replace(lower(h), '[^a-z0-9]+', ' '))",
}


def register(spark: SparkSession) -> list[str]:
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in _FUNCTIONS]
