"""Operators on small hand-made tables."""

import json
import random
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge import config
from tidegauge.operators import articles as A
from tidegauge.operators import assessments as M
from tidegauge.operators import events as E
from tidegauge.operators import index as I
from tidegauge.operators import matching
from tidegauge.operators import scoring as S
from tidegauge.plans import datasets, pipeline, routes
from tidegauge.plans.cache import LatestRefresh
from tidegauge.sources import schemas, warehouse

ARTICLE = "publisher string, reliability double, bias_note string, url string, headline string, excerpt string, published_at timestamp_ntz, source_ord bigint, item_ord bigint"


def at(s):
    return datetime.fromisoformat(s)


def test_deduplicate_equals_a_map(spark):
    """First row of a key gives the place, a strictly more reliable later one the payload."""
    rng = random.Random(7)
    rows = []
    for i in range(200):
        rows.append((f"p{i % 5}", rng.choice([0.5, 0.6, 0.9]), None, f"u{i}", rng.choice(["A b", "a-B!", "c", "新", "d e"]), "", at(f"2024-01-0{rng.randint(1, 5)}"), i % 5, i))
    ordered = sorted(rows, key=lambda r: (-r[6].timestamp(), r[7], r[8]))
    kept = {}
    for r in ordered:
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in r[4].lower()).split())
        if key not in kept or r[1] > kept[key][1]:
            kept[key] = r
    got = [r.url for r in A.deduplicate(spark.createDataFrame(rows, ARTICLE)).orderBy("pos").collect()]
    assert got == [r[3] for r in kept.values()]
    assert [r.url for r in A.first_articles(A.deduplicate(spark.createDataFrame(rows, ARTICLE)), 2).collect()] == got[:2]


GOOD = {"url": "u1", "category": "health", "sentiment": 0.5, "severity": 2, "scale": 1e-1, "confidence": 0.5, "durationHours": 0, "rationale": "  ok " + "x" * 700}


def parse(spark, *raws):
    return {(r.response_ord, r.pos): r for r in M.parse_assessments(spark.createDataFrame(list(enumerate(raws)), "response_ord int, raw string")).collect()}


def test_parse_assessments(spark):
    bad = [7, None, "x", [], {}, {**GOOD, "sentiment": "0.5"}, {**GOOD, "url": 5}, {**GOOD, "category": "weather"}, {**GOOD, "rationale": None}, {k: v for k, v in GOOD.items() if k != "scale"}]
    got = parse(spark, json.dumps({"assessments": bad + [GOOD]}), "no json", "{}", '{"assessments": 5}', None, "```json\n" + json.dumps({"assessments": [GOOD]}) + "\n```", "")
    assert set(got) == {(0, len(bad)), (5, 0)}
    r = got[5, 0]
    assert (r.sentiment, r.severity, r.scale, r.confidence, r.duration_hours) == (0.5, 1.0, 0.1, 0.5, 1.0) and len(r.rationale) == 600 and r.rationale.startswith("ok")


def test_last_assessment_wins_and_unasked_are_dropped(spark):
    a = [{**GOOD, "severity": 0.1}, {**GOOD, "severity": 0.9}, {**GOOD, "url": "other"}]
    parsed = M.parse_assessments(spark.createDataFrame([(0, json.dumps({"assessments": a}))], "response_ord int, raw string"))
    got = M.last_of_each(M.requested_only(parsed, spark.createDataFrame([("u1",)], "url string"))).collect()
    assert [(r.url, r.severity) for r in got] == [("u1", 0.9)]


def test_provider_failures_fall_back(spark):
    articles = datasets.samples(spark)

    def provider(rows):
        if any("Museum" in r["headline"] for r in rows):
            raise OSError("down")
        return json.dumps({"assessments": [{**GOOD, "url": r["url"]} for r in rows]})

    asked = M.ask(articles.coalesce(1), provider, batch=1)
    scored = pipeline.scored(articles, datasets.now(), asked, None).select(F.get("sources", 0)["url"].alias("url"), "title", F.get("score.uncertainty_notes", 0).alias("note")).collect()
    assert {r.title for r in scored if r.note == config.NOTE_FALLBACK} == {"Museum opens film and music season"}
    assert json.loads(M.request_json(articles.limit(1)).first().request)["publishedAt"].endswith("Z")


def test_validation(spark):
    fine = (0.5, 0.5, 0.5, 0.5, 0.5, 1.0, "r")
    rows = [fine] + [tuple(2.0 if j == k else v for j, v in enumerate(fine)) for k in range(5)] + [(*fine[:5], 0.0, "r"), (*fine[:6], "  "), (float("nan"), -0.1, *fine[2:]), (*fine[:6], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sentiment double, severity double, scale double, novelty double, confidence double, duration_hours double, rationale string")
    got = [r.e for r in df.select("i", S.validation_errors().alias("e")).orderBy("i").collect()]
    assert [len(e) for e in got] == [0, 1, 1, 1, 1, 1, 1, 1, 2, 1] and got[1] == ["sentiment must be between -1 and 1."]
    assert [r.m for r in df.select("i", S.missing_fields(("rationale", "scale")).alias("m")).orderBy("i").collect()][-1] == ["rationale"]


def test_impact_stays_in_bounds_and_decays(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-1, 1), *[rng.random() for _ in range(4)], rng.choice(config.CATEGORIES), rng.uniform(1, 9000), rng.uniform(0, 500)) for _ in range(300)]
    df = spark.createDataFrame(rows, "sentiment double, severity double, scale double, novelty double, confidence double, category string, duration_hours double, age_hours double")
    for r in S.with_impact(df).collect():
        assert abs(r.impact) <= 10 * 1.2 * 1.5 and abs(r.current_impact) <= abs(r.impact) + 1e-9


def test_overrides_and_rescoring(spark):
    ddl = "event_id string, id string, sentiment double, severity double, scale double, novelty double, confidence double, duration_hours double, category string, impact double, is_active boolean, created_at timestamp"
    first = (("e1", "s1", 1.0, 0.5, 0.5, 0.5, 0.5, 90.0, "economy", 0.0, True, at("2024-01-01")), ("e2", "s2", 1.0, 0.5, 0.5, 0.5, 0.5, 90.0, "economy", 0.0, True, at("2024-01-01")))
    scores = spark.createDataFrame(first, ddl)
    overrides = spark.createDataFrame([("e1", -1.0, None), ("e2", None, True)], "event_id string, sentiment double, disabled boolean")
    got = {r.event_id: (r.sentiment, r.impact, r.is_active) for r in S.apply_overrides(scores, overrides).collect()}
    assert got == {"e1": (-1.0, -0.62, True), "e2": (1.0, 0.63, False)}
    new = spark.createDataFrame([("e1", "s3", *first[0][2:11], at("2024-01-02"))], ddl)
    assert {r.id: r.is_active for r in S.rescore(scores, new).collect()} == {"s1": False, "s2": True, "s3": True}
    assert {r.event_id: r.id for r in E.active_scores(S.rescore(scores, new)).collect()} == {"e1": "s3", "e2": "s2"}


SNAPSHOT = schemas.TABLES["index_snapshots"].ddl


def test_snapshots_follow_the_recurrence(spark):
    previous, index, last = spark.createDataFrame([], SNAPSHOT), None, 0.0
    sums = []
    for k, impacts in enumerate([[1.5, -0.5, 0.0], [], [2.25], [-3.0, 1.0]]):
        events = spark.createDataFrame([(float(x),) for x in impacts], "current_impact double")
        now = F.lit(f"2024-01-0{k + 1} 00:00:00").cast("timestamp")
        row = I.snapshot(events, previous, now).withColumn("id", F.lit(str(k)))
        got = row.first()
        pressure = sum(impacts)
        index = 1000 + pressure if index is None else index + pressure - last
        assert (got.current_index, got.change_since_previous, got.active_event_count) == (pytest.approx(index), pytest.approx(0 if k == 0 else pressure - last), len(impacts))
        last = pressure
        previous = spark.createDataFrame(schemas.conform(previous.unionByName(schemas.conform(row, "index_snapshots", now)), "index_snapshots", now).collect(), SNAPSHOT)
        sums.append((at(f"2024-01-0{k + 1}"), sum(x for x in impacts if x > 0) * 1.0, sum(x for x in impacts if x < 0) * 1.0, len(impacts)))
    series = I.snapshot_series(spark.createDataFrame(sums, "snapshot_at timestamp_ntz, positive_sum double, negative_sum double, active_events bigint"))
    stored = [r.current_index for r in previous.orderBy("snapshot_at").collect()]
    assert [r.current_index for r in series.orderBy("snapshot_at").collect()] == pytest.approx(stored)
    assert [r.current_index for r in I.history(previous, 2).collect()] == pytest.approx(stored[-2:])


def test_asof_join_equals_search(spark):
    rng = random.Random(5)
    left = [(i, f"k{i % 2}", None if i == 9 else at(f"2024-01-{rng.randint(1, 20):02d}T{rng.randint(0, 23):02d}:00:00")) for i in range(60)]
    right = [(f"k{i % 3}", at(f"2024-01-{rng.randint(3, 20):02d}T{rng.randint(0, 23):02d}:00:00"), i) for i in range(25)]
    got = I.asof_join(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int"), "t", "u", ["v"], ["k"]).collect()
    want = {}
    for i, k, t in left:
        older = [(u, v) for kk, u, v in right if kk == k and t is not None and u < t]
        want[i] = {v for u, v in older if u == max(older)[0]} if older else {None}
    assert len(got) == 60 and all(r.v in want[r.id] for r in got)


def test_clusters_and_life_cycle(spark):
    rows = [
        ("a", 0.9, None, "u1", "Big quake", "", at("2024-01-04"), 0, 0), ("a", 0.9, None, "u2", "big QUAKE!", "", at("2024-01-05"), 0, 1), ("b", 0.5, None, "u3", "Big, quake", "", at("2024-01-03"), 1, 0),
        ("a", 0.9, None, "u4", "新", "", at("2023-01-03"), 0, 2), ("b", 0.9, None, "u5", "闻", "", at("2024-01-03"), 1, 1),
    ]
    clustered = E.cluster(spark.createDataFrame(rows, ARTICLE))
    assert {r.url: r.relation_type for r in clustered.collect()} == {"u1": "primary", "u2": "duplicate", "u3": "supporting", "u4": "primary", "u5": "primary"}
    got = {r.event_key: (r.source_count, r.status) for r in E.life_cycle(E.source_counts(clustered), F.lit("2024-01-06").cast("timestamp")).collect()}
    assert got == {"big quake": (2, "updated"), "url:u4": (1, "resolved"), "url:u5": (1, "emerging")}


def test_refresh_and_routes(spark):
    samples = datasets.samples(spark)
    run = pipeline.refresh(samples, datasets.now().cast("timestamp"), spark.createDataFrame([], SNAPSHOT))
    events = run.events.collect()
    assert events and all(r.score.sentiment != 0 for r in events)
    assert [abs(r.current_impact) for r in events] == sorted((abs(r.current_impact) for r in events), reverse=True)
    assert run.summary().first().event_count == len(events) and run.history.count() == 1
    movers = routes.top_movers(run).collect()
    assert all((r.current_impact > 0) == (r.direction == "positive") for r in movers) and len(movers) <= 10
    one = events[0]
    assert routes.event(run, one.event_id).first().title == one.title
    assert routes.event_not_found(run, "nobody").first().error.code == "event_not_found" and routes.event_not_found(run, one.event_id).count() == 0
    seen, after = [], None
    while rows := routes.events(run, 3, after).collect():
        seen += [r.event_id for r in rows]
        after = (abs(rows[-1].current_impact), rows[-1].event_id)
    assert sorted(seen) == sorted(r.event_id for r in events)
    assert json.loads(routes.as_json(routes.articles(run)).first().value)["publisher"]
    catalog = spark.createDataFrame([("Daily", 0.8), ("Nobody", 0.1)], "name string, reliability double")
    counts, listed = routes.ingestion(catalog, samples, "DAILY")
    assert [tuple(r) for r in counts.collect()] == [("Daily", listed.count())]
    assert {r.source: r.n for r in routes.ingestion(catalog, samples)[0].collect()}["Nobody"] == 0


def test_warehouse(spark, tmp_path):
    root, now = str(tmp_path), F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([("1", "n", "f", "en"), ("1", "n", "f", "en"), ("2", "m", "g", "en")], "id string, name string, feed_url string, language string")
    warehouse.append(rows, root, "sources", now)
    warehouse.append(rows.union(spark.createDataFrame([("3", "o", "h", "de")])), root, "sources", now)
    stored = warehouse.read(spark, root, "sources")
    assert sorted((r.id, r.source_type, r.reliability_score, r.fetch_interval_minutes, r.is_active) for r in stored.collect()) == [(i, "rss", 0.5, 60, True) for i in "123"]
    articles = spark.createDataFrame([("a", "1", "u"), ("b", "9", "u"), (None, "2", None)], "id string, source_id string, url string")
    found = {(r.rule, r.value): r.n for r in warehouse.audit({"sources": stored, "articles": schemas.conform(articles, "articles", now)}).filter("table_name = 'articles'").collect()}
    assert found["unique url", "u"] == 2 and found["source_id in sources", "9"] == 1 and found["not null", "id"] == 1 and found["not null", "headline"] == 3


def test_article_upkeep(spark):
    now = F.lit("2024-01-05").cast("timestamp")
    rows = spark.createDataFrame([("a", "new", None, at("2024-01-01")), ("b", "new", None, at("2024-01-04T23:00:00")), ("c", "done", None, at("2024-01-01"))], "id string, status string, failure_reason string, updated_at timestamp")
    assert [r.id for r in A.stale_articles(rows, now, 24).collect()] == ["a"]
    failed = A.mark_failed(rows, spark.createDataFrame([("b", "x"), ("b", "y")], "id string, reason string"))
    assert {r.id: (r.status, r.failure_reason) for r in failed.collect()} == {"a": ("new", None), "b": ("failed", "x; y"), "c": ("done", None)}


def test_latest_refresh(spark):
    clock, made = [0.0], []

    def make():
        made.append(1)
        return pipeline.refresh(datasets.samples(spark), datasets.now().cast("timestamp"), spark.createDataFrame([], SNAPSHOT))

    latest = LatestRefresh(make, clock=lambda: clock[0])
    first = latest.get()
    assert latest.get() is first and len(made) == 1
    assert latest.get(force=True) is not first and len(made) == 2
    clock[0] = 301.0
    latest.get()
    assert len(made) == 3
    for view in latest.views():
        assert spark.table(view).count() > 0


def test_contributor_rows(spark):
    events = spark.createDataFrame([("e1", 1.5, 2.0), ("e2", -1.0, 3.0)], "event_id string, current_impact double, age_hours double")
    scores = spark.createDataFrame([("s1", "e1", True), ("s0", "e1", False), ("s2", "e2", True)], "id string, event_id string, is_active boolean")
    rows = schemas.conform(I.contributor_rows(events, scores, F.lit("7")), "index_snapshot_events", F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.id, r.event_score_id, r.current_impact, r.hours_since_detected) for r in rows.collect()) == [("7/e1", "s1", 1.5, 2.0), ("7/e2", "s2", -1.0, 3.0)]


def test_import_takes_one_row_of_each_url(spark):
    candidates = spark.createDataFrame([("u1", "h", "x"), ("u1", "h", "y"), ("u2", "h", "x"), ("u3", "h", "z"), ("u4", "k", "z")], "url string, headline string, excerpt string")
    stored = spark.createDataFrame([("u4", "none")], "url string, content_hash string")
    got = A.importable(candidates, stored).collect()
    assert sorted(r.url for r in got) in (["u1", "u3"], ["u1", "u2", "u3"]) and len({r.content_hash for r in got}) == len(got)
    assert A.importable(candidates.limit(0), stored).count() == 0


def test_settle(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["new", "new", "new", "new", "failed"])], "id bigint, status string")
    links = spark.createDataFrame([(0, "duplicate"), (0, "duplicate"), (1, "duplicate"), (1, "primary"), (2, "supporting"), (4, "primary")], "article_id bigint, relation_type string")
    assert {r.id: r.status for r in A.settle(rows, links).collect()} == {0: "duplicate", 1: "processed", 2: "processed", 3: "ignored", 4: "failed"}


def test_reinforced_events_decay_from_the_newest_article(spark):
    events = spark.createDataFrame([("a", 8.0, 0.1), ("b", 8.0, 0.1), ("c", 8.0, 0.1)], "event_id string, impact double, decay_rate double")
    updates = spark.createDataFrame([("a", at("2024-01-01")), ("a", at("2024-01-03")), ("b", at("2024-01-01"))], "event_id string, at timestamp")
    got = {r.event_id: r.current_impact for r in E.reinforced(events, updates, F.lit("2024-01-03").cast("timestamp")).collect()}
    assert got == {"a": 8.0, "b": round(8 * 2.718281828459045**-4.8, 2)}


def test_chart(spark):
    rows = spark.createDataFrame([(at("2024-01-01T10:00:00"), 1000.0), (at("2024-01-01T12:30:00"), 1010.0), (at("2024-01-01T11:00:00"), 1005.0)], "snapshot_at timestamp, current_index double")
    points = I.chart_points(rows, 100, 10)
    assert [(r.label, r.x, r.y) for r in points.orderBy("snapshot_at").collect()] == [("10:00", 0.0, 10.0), ("11:00", 50.0, 5.0), ("12:30", 100.0, 0.0)]
    assert 'points="0.00,10.00 50.00,5.00 100.00,0.00"' in I.chart_svg(points, 100, 10).first().svg
    assert [r.y for r in I.chart_points(rows.limit(1), 100, 10).collect()] == [5.0]


def test_matching_equals_all_pairs(spark):
    """Against every pair, with many equal sets, sets within sets and similarities that just reach the threshold."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of"] * 4
    headline = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))
    pool = [headline() for _ in range(60)]
    asked = [(f"u{i % 190}", rng.choice([headline(), rng.choice(pool)])) for i in range(200)]
    known = [(i, rng.choice([headline(), rng.choice(pool)])) for i in range(200)]
    for threshold in (0.3, 0.5, 2 / 3, 0.8, 1.0):
        want = {}
        for url, x in asked:
            for event, y in known:
                a, b = set(x.split()), set(y.split())
                if a and b and len(a & b) / len(a | b) >= threshold:
                    want[url] = min(want.get(url, (0, 0)), (-len(a & b) / len(a | b), event))
        found = matching.match_events(spark.createDataFrame(asked, "url string, headline string"), spark.createDataFrame(known, "event_id bigint, title string"), threshold)
        assert {r.url: (-r.similarity, r.event_id) for r in found.collect()} == want


def test_matching_compares_equal_headlines_once(spark):
    """20,000 articles and 20,000 events with one headline: 400 million pairs, if each were looked at."""
    ids = spark.range(20_000)
    asked = ids.select(F.col("id").cast("string").alias("url"), F.lit("harbour wall breaks in storm").alias("headline"))
    known = ids.select((F.col("id") + 5).alias("event_id"), F.lit("Storm breaks harbour wall").alias("title"))
    spark.sparkContext.setJobGroup("equal headlines", "matching", True)
    timer = threading.Timer(60, spark.sparkContext.cancelJobGroup, ["equal headlines"])
    timer.start()
    try:
        found = matching.match_events(asked, known).agg(F.count("*"), F.min("event_id"), F.max("event_id"), F.min("similarity")).first()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(found) == (20_000, 5, 5, 0.8)


def test_a_filter_on_hits_cleans_no_text_twice(spark):
    """A filter pushed below the word counts would clean the excerpt once for each term of the lists."""
    found = E.candidates(S.keyword_features(datasets.samples(spark), datasets.now()), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>") == 1
    assert {r.url.rsplit("/", 1)[1] for r in found.select("url").collect()} >= {"0", "4", "14"}


def test_sorting_by_impact_scores_once(spark):
    """The sort samples its input; below the sort lies a shuffle, so that the sample isn't scored anew."""
    rows = spark.createDataFrame([(f"e{i}", float(i % 5 - 2), i) for i in range(50)], "event_id string, current_impact double, pos int")
    calls = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    shown = E.by_impact(rows.mapInPandas(seen, rows.schema))
    got = [(r.event_id, r.current_impact) for r in shown.collect()]
    assert got == [(f"e{i}", float(i % 5 - 2)) for i in sorted(range(50), key=lambda i: (-abs(i % 5 - 2), i))]
    assert calls.value == 50
