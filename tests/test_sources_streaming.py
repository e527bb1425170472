"""Feeds, and streams against their batch twins."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import index as I
from tidegauge.plans import datasets, pipeline
from tidegauge.sources import feeds, schemas, warehouse
from tidegauge.streaming import refresh as R

RSS = """<?xml version="1.0"?><rss><channel><title>x</title>
<item><title>War &amp; peace</title><link>http://a/1</link><pubDate>Wed, 03 Jan 2024 10:20:30 GMT</pubDate><description><![CDATA[<p>One <b>two</b></p>]]></description></item>
<item><title>No link</title></item>
<item><title></title><link>http://a/3</link></item>
<item><title>Bare</title><link>http://a/4</link></item></channel></rss>"""


class LocalFeeds(feeds.FeedDataSource):
    @staticmethod
    def fetch(url):
        if url == "dead":
            raise TimeoutError("15 s")
        return RSS.encode()

    @classmethod
    def name(cls):
        return "localfeed"


def test_landed_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    now = F.lit("2024-01-05").cast("timestamp")
    rows = feeds.items_to_articles(feeds.read_landed(spark, str(tmp_path)), now).orderBy("url").collect()
    assert [(r.url, r.headline, str(r.published_at), r.excerpt) for r in rows] == [("http://a/1", "War & peace", "2024-01-03 10:20:30", "One two"), ("http://a/4", "Bare", "2024-01-05 00:00:00", "")]


def test_source_types(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"link": "http://a", "title": "T", "content": "c"}\nbroken\n')
    (tmp_path / "m.csv").write_text('link,title,pubDate,contentSnippet,content\nhttp://b,"U, ""x""",2024-01-01T00:00:00Z,s,\n')
    (tmp_path / "r.xml").write_text(RSS)
    now = F.lit("2024-01-05").cast("timestamp")
    got = [feeds.items_to_articles(feeds.read_items(spark, kind, str(tmp_path / name)), now).collect() for kind, name in (("api", "a.json"), ("manual", "m.csv"), ("rss", "r.xml"))]
    assert [(r.url, r.headline, r.excerpt) for r in got[0] + got[1]] == [("http://a", "T", "c"), ("http://b", 'U, "x"', "s")] and len(got[2]) == 2
    with pytest.raises(ValueError):
        feeds.read_items(spark, "fax", "x")


def test_live_feeds(spark):
    df = feeds.scan_feeds(spark, [("A", "one"), ("B", "dead"), ("C", "two")], source=LocalFeeds)
    assert {r.publisher: r["count"] for r in df.groupBy("publisher").count().collect()} == {"A": 4, "C": 4}
    failed = feeds.scan_feeds(spark, [("B", "dead")], errors=True, source=LocalFeeds).collect()
    assert [(r.publisher, r.error) for r in failed] == [("B", "TimeoutError: 15 s")]
    articles = feeds.items_to_articles(df, F.lit("2024-01-05").cast("timestamp"))
    assert articles.count() == 4 and set(articles.columns) >= {"publisher", "source_ord", "item_ord", "url", "headline", "published_at", "excerpt"}


def test_refresh_stream_equals_batches(spark, tmp_path):
    samples, inbox, root = datasets.samples(spark), str(tmp_path / "in"), str(tmp_path / "wh")
    schema = samples.schema
    nows = [F.lit(f"2024-01-0{5 + k} 00:00:00").cast("timestamp") for k in range(2)]
    parts = [samples.filter("item_ord < 9"), samples.filter("item_ord >= 9")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        R.refresh_writer(stream, root, lambda n: nows[n]).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = warehouse.read(spark, root, "index_snapshots").orderBy("snapshot_at").collect()
    previous = spark.createDataFrame([], schemas.TABLES["index_snapshots"].schema)
    first = pipeline.refresh(parts[0], nows[0], previous).snapshot.first()
    second = pipeline.refresh(parts[1], nows[1], warehouse.read(spark, root, "index_snapshots").filter("id = '0'")).snapshot.first()
    assert [(r.current_index, r.change_since_previous) for r in got] == [(first.current_index, 0.0), (second.current_index, second.change_since_previous)]


def stream_of(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name, mode, state):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_running_index_equals_batch(spark, sf_dir, tmp_path):
    events = datasets.impact_events(spark, sf_dir)
    stream = stream_of(spark, events, str(tmp_path / "in"))
    drain(R.running_index(stream), "running", "update", str(tmp_path / "state"))
    got = {r.scope: (r.current_index, r.events) for r in spark.table("running").collect()}
    want = {r.scope: (r.current_index, r.active_events) for r in I.scope_index(events).filter("scope is not null").collect()}
    assert got == want


def test_first_by_headline(spark, tmp_path):
    articles = datasets.samples(spark).withColumn("published_at", F.col("published_at").cast("timestamp"))
    drain(R.first_by_headline(stream_of(spark, articles, str(tmp_path / "in"))), "firsts", "append", str(tmp_path / "state"))
    keys = [r.headline_key for r in spark.table("firsts").collect()]
    assert len(keys) == len(set(keys)) == len({r.headline_key for r in spark.table("firsts").collect()}) and keys.count("deadly earthquake strikes city") == 1


def test_a_failed_refresh_is_logged_and_the_stream_goes_on(spark, tmp_path, caplog):
    samples, root = datasets.samples(spark), str(tmp_path / "wh")

    def now(number):
        if number == 0:
            raise RuntimeError("no clock")
        return F.lit("2024-01-05").cast("timestamp")

    for _ in range(2):
        stream = stream_of(spark, samples, str(tmp_path / "in"))
        R.refresh_writer(stream, root, now).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in warehouse.read(spark, root, "index_snapshots").collect()] == ["1"] and "refresh 0 failed" in caplog.text
    with pytest.raises(Exception, match="no clock"):
        R.refresh_writer(stream, root, now, swallow=False).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()


def test_half_hour():
    class Writer:
        def trigger(self, **given):
            self.given = given
            return self

    assert R.every_half_hour(Writer()).given == {"processingTime": "30 minutes"}


def test_a_feed_is_not_held_whole():
    """20,000 items, with others among them, in the memory of a few; a feed torn after its last item gives none."""
    import tracemalloc

    item = "<item><title>t %d</title><description>&lt;p&gt;a &lt;b&gt;b&lt;/b&gt;&lt;/p&gt;</description><guid>x</guid></item><other><title>no item</title></other>\n"
    body = "".join(item % k for k in range(20_000)).encode()
    raw = b"<rss><channel><title>c</title>" + body + b"</channel></rss>"
    tracemalloc.start()
    try:
        for k, row in enumerate(feeds.parse_rss(raw)):
            assert row == (None, f"t {k}", None, "a b", "<p>a <b>b</b></p>")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert k == 19_999 and peak < 2_000_000
    with pytest.raises(ET.ParseError):
        next(iter(feeds.parse_rss(raw[:-6])))


def test_refreshed_articles_are_written_side_by_side(spark, sf_dir, tmp_path, monkeypatch):
    """Each of the three batches is written by as many tasks as its articles have parts, not by one."""
    from tidegauge import served

    articles = served.data.articles
    monkeypatch.setattr(served, "shared_path", lambda _, what: f"file://{tmp_path}/{what}")
    monkeypatch.setattr(served.data, "articles", lambda s, d: articles(s, d).repartition(4))
    assert {r.id for r in served.stream_refresh(spark, sf_dir).collect()} == {"0", "2"}
    assert len(list((tmp_path / "articles").glob("*.parquet"))) == 12
