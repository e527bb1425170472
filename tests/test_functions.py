"""Scalar functions, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from tidegauge import config
from tidegauge.functions import numbers as N
from tidegauge.functions import sql, text as X, times as D


def values(spark, ddl, rows, make):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ddl)
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_rounding_goes_up_at_halves(spark):
    given = [1.005, -0.025, 0.005, -0.005, 0.0, 2.675, -1.345, None]
    want = [math.floor(x * 100 + 0.5) / 100 if x is not None else None for x in given]
    assert values(spark, "x double", given, N.round2) == want
    assert want[1] == -0.02 and want[0] in (1.0, 1.01)


def test_clamp(spark):
    got = values(spark, "x double", [-2.0, 0.5, 3.0, None, float("nan"), float("inf")], lambda x: N.clamp(x, -1, 1))
    assert got[:4] == [-1.0, 0.5, 1.0, None] and math.isnan(got[4]) and got[5] == 1.0


def test_duration_weight(spark):
    got = values(spark, "x double", [0.0, 72.0, 336.0, 990.0, 1440.0, -5.0, -10.0], N.duration_weight)
    assert got[:1] == [0.5] and got[1] == pytest.approx(0.9569, abs=1e-4) and got[2] == pytest.approx(1.2695, abs=1e-4) and got[3:6] == [1.5, 1.5, 0.5] and got[6] is None


def test_between(spark):
    assert values(spark, "x double", [0.0, 1.0, 1.1, None, float("nan"), float("inf")], lambda x: N.is_between(x, 0, 1)) == [True, True, False, False, False, False]


def test_novelty_and_scope(spark):
    assert values(spark, "x double", [0.0, 8.4, 84.0, 134.4, 500.0], N.novelty) == pytest.approx([0.95, 0.95, 0.5, 0.2, 0.2])
    assert values(spark, "x double", [0.8, 0.55, 0.54, 1.0], N.scope_of) == ["global", "regional", "local", "global"]
    assert values(spark, "x double", [0.0, 1.234, -1.2], N.signed) == ["+0.00", "+1.23", "-1.20"]


def test_headline_key(spark):
    assert values(spark, "x string", ["Deadly: Quake, 2024!", "!!!", "新闻", "Été à Paris", None, ""], X.headline_key) == ["deadly quake 2024", "", "", "t paris", None, ""]


def test_strip_html(spark):
    given = ["<p>a<b>b</b></p>", "a < b", "x \u000b﻿\ty\n", "&amp; stays", "", None]
    assert values(spark, "x string", given, X.strip_html) == ["a b", "a < b", "x y", "&amp; stays", "", None]


def test_all_white_space(spark):
    white = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    kept = [0x85, 0x1C, 0x180E, 0x200B]
    assert values(spark, "x string", [f"a{chr(c)}b" for c in white + kept], X.strip_html) == ["a b"] * 25 + [f"a{chr(c)}b" for c in kept]


def test_terms_are_substrings_and_count_once(spark):
    assert values(spark, "x string", ["he said war war", "award", "nothing"], lambda _: X.count_terms("x", ("aid", "war"))) == [2, 1, 0]
    assert values(spark, "x string", ["a film about war", "film", "none"], lambda _: X.first_category("x")) == ["conflict", "culture", "governance"]
    assert values(spark, "x string", ["mass", "global city", "city", "x"], X.keyword_scale) == [0.35, 0.8, 0.55, 0.35]
    assert values(spark, "x string", ["a major thing", ""], X.severity_bonus) == [0.2, 0.0]
    assert values(spark, "x string", ["war", "health", "x"], lambda x: X.keyword_duration(x, x)) == [1440.0, 336.0, 72.0]


def rolling(s):
    h, raw = 0, s.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2], "big") + 2**31) % 2**32 - 2**31
    return h


def test_rolling_hash(spark):
    given = ["", "abc", "é", "日本", "😀 x", "https://example.com/a/very/long/path?with=query", "polygenelubricants"]
    assert values(spark, "x string", given, X.rolling_hash) == [rolling(s) for s in given]
    ids = values(spark, "x string", given, X.event_id)
    assert [int(i[4:], 36) for i in ids] == [abs(rolling(s)) for s in given] and ids[1] == "rss_22ci"
    assert rolling("polygenelubricants") == -(2**31)


def test_code_fence(spark):
    assert values(spark, "x string", ["```json\n{}\n```", " ```JSON {} ``` ", "{}"], X.strip_code_fence) == ["{}", "{}", "{}"]


def test_rationale(spark):
    df = spark.createDataFrame([(1.0, 0, 1), (-0.5, 3, 1), (0.0, 0, 0)], "s double, n int, p int")
    got = [r.v for r in df.select(X.keyword_rationale(F.col("s"), F.lit("health"), F.col("n"), F.col("p")).alias("v")).collect()]
    assert got == ["Keywords show 1 positive health signal in headline and excerpt.", "Keywords show 3 negative health signals in headline and excerpt.", "Headline and excerpt show no direction."]
    assert values(spark, "x string", ["", "y"], X.summary_or_default) == [config.NO_SUMMARY, "y"]


def test_ages(spark):
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    got = values(spark, "x string", ["2024-01-04 12:00:00", "2024-01-06 00:00:00", "2024-01-05 00:00:00"], lambda x: D.age_hours(x.cast("timestamp"), now))
    assert got == [12.0, 0.0, 0.0]
    assert values(spark, "x string", ["2024-01-04 12:00:00.25"], lambda x: D.iso(x.cast("timestamp"))) == ["2024-01-04T12:00:00.250Z"]


def test_sql_functions(spark):
    assert len(sql.register(spark)) == 7
    row = spark.sql("SELECT tg_round2(0.125D) a, tg_duration_weight(990D) b, tg_decay_rate(0.5D) c, tg_novelty(0D) d, tg_scope(0.6D) e, tg_headline_key('A-b') f, tg_current_impact(2D, 1D, -3D) g").first()
    assert tuple(row) == (0.13, 1.5, 1.0, 0.95, "regional", "a b", 2.0)
