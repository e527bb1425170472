"""Model assessments: strict reading of JSON responses, and their join to articles.

Responses are Variants, so a bad element is dropped alone and a number given as a string is
no number. A response that can't be read, or has no list, gives nothing: its articles fall
back to keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numbers import clamp
from ..functions.text import strip_code_fence, strip_html

NUMBERS = {"sentiment": (-1, 1), "severity": (0, 1), "scale": (0, 1), "confidence": (0, 1), "durationHours": (1, config.MAX_DURATION_HOURS)}
ASSESSMENT = "url string, category string, sentiment double, severity double, scale double, confidence double, duration_hours double, rationale string"


def _kind(element: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(element, f"$.{name}", "variant"))


def parse_assessments(responses: DataFrame) -> DataFrame:
    """Valid assessments of responses(response_ord, raw), with their place (response_ord, pos)."""
    parsed = responses.select("response_ord", F.try_parse_json(strip_code_fence(F.col("raw"))).alias("v"))
    listed = parsed.select("response_ord", F.posexplode(F.try_variant_get("v", "$.assessments", "array<variant>")).alias("pos", "e"))
    e = F.col("e")
    ok = F.coalesce(F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), F.lit(False))
    for name in ("url", "category", "rationale"):
        ok = ok & F.coalesce(_kind(e, name) == "STRING", F.lit(False))
    for name in NUMBERS:
        kind = _kind(e, name)
        ok = ok & F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.lit(False))
    get = lambda name, kind: F.try_variant_get(e, f"$.{name}", kind)
    numbers = [clamp(get(n, "double"), *NUMBERS[n]).alias("duration_hours" if n == "durationHours" else n) for n in NUMBERS]
    rows = listed.filter(ok).select("response_ord", "pos", get("url", "string").alias("url"), get("category", "string").alias("category"), *numbers, F.substring(F.trim(get("rationale", "string")), 1, config.MAX_RATIONALE).alias("rationale"))
    finite = F.lit(True)
    for n in ("sentiment", "severity", "scale", "confidence", "duration_hours"):
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n)
    return rows.filter(F.col("category").isin(*config.CATEGORIES) & finite)


def last_of_each(assessments: DataFrame) -> DataFrame:
    """The last assessment of each url."""
    values = [c for c in assessments.columns if c not in ("url", "response_ord", "pos")]
    latest = assessments.groupBy("url").agg(F.max_by(F.struct(*values), F.struct("response_ord", "pos")).alias("a"))
    return latest.select("url", "a.*")


def requested_only(assessments: DataFrame, articles: DataFrame) -> DataFrame:
    return assessments.join(articles.select("url"), "url", "left_semi")


def request_rows(articles: DataFrame) -> DataFrame:
    return articles.select("url", "headline", strip_html(F.col("excerpt")).alias("excerpt"), "publisher", "published_at")


def request_json(articles: DataFrame) -> DataFrame:
    return request_rows(articles).select("url", F.to_json(F.struct("url", "headline", "excerpt", "publisher", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))).alias("request"))


#: Answers that a Python worker hands on at once.
ANSWERS = 500


def ask(articles: DataFrame, provider: Callable[[list[dict]], str], batch: int = config.MAX_ARTICLES) -> DataFrame:
    """responses(response_ord, raw) of a provider that answers a batch of requests with JSON; a call that fails gives null."""

    def answers(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([n for n, _ in rows], pa.int64()), pa.array([raw for _, raw in rows], pa.string())], names=["response_ord", "raw"])

    def run(blocks: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for block in blocks:
            for lo in range(0, block.num_rows, batch):
                part = block.slice(lo, batch).to_pylist()  # the texts of one call at a time as Python's
                n = [r.pop("n") for r in part][0]
                try:
                    raw = provider(part)
                except Exception:  # the articles of a failed call fall back to keywords
                    raw = None
                out.append((n, raw))
                if len(out) >= ANSWERS:
                    yield answers(out)
                    out.clear()
        if out:
            yield answers(out)

    rows = request_rows(articles).withColumn("published_at", F.col("published_at").cast("string")).withColumn("n", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "response_ord bigint, raw string")
