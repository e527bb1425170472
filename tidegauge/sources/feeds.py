"""News feeds: landed RSS files through Spark's XML reader, live ones through a Python data source."""

from __future__ import annotations

import io
import json
import shutil
import tempfile
import threading
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import config
from ..functions import text, times
from .schemas import FEED_ITEM

TIMEOUT_SECONDS = 15
USER_AGENT = "tidegauge/0.1"
SOURCE_DDL = "name string, feed_url string, homepage_url string, language string, reliability double, bias_note string"


def source_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(config.SOURCES), SOURCE_DDL)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: link, title, pubDate, contentSnippet (the description without markup), content."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("link string, title string, pubDate string, description string").load(path)
    return raw.select("link", "title", "pubDate", text.strip_html(F.col("description")).alias("contentSnippet"), F.col("description").alias("content"))


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """Items landed as JSON lines by a caller of some interface; unreadable lines give no item."""
    return spark.read.schema(FEED_ITEM).json(path)


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """Items entered by hand: CSV files with a header."""
    return spark.read.schema(FEED_ITEM).csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')


READERS = {"rss": read_landed, "api": read_api, "manual": read_manual}


def read_items(spark: SparkSession, source_type: str, path: str) -> DataFrame:
    """Items of a source by its type; more types are entries of READERS."""
    if source_type not in READERS:
        raise ValueError(f"unknown source type {source_type!r}; known: {', '.join(sorted(READERS))}")
    return READERS[source_type](spark, path)


def items_to_articles(items: DataFrame, now: Column) -> DataFrame:
    """Items with a link and a title as articles; the date defaults to the run's time, the excerpt to the content and then to ''."""
    usable = items.filter("link is not null and link <> '' and title is not null and title <> ''")
    given = [c for c in items.columns if c not in {"link", "title", "pubDate", "contentSnippet", "content"}]
    return usable.select(
        *given, F.col("link").alias("url"), F.col("title").alias("headline"), times.parse_published(F.col("pubDate"), now).alias("published_at"),
        F.coalesce("contentSnippet", "content", F.lit("")).alias("excerpt"),
    )


def union_all(feeds: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, feeds)


def fetch_url(url: str) -> BinaryIO:
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as response:
        return _kept(response)


def fetch_file(url: str) -> BinaryIO:
    """A feed from a file system that pyarrow knows; web addresses as by fetch_url."""
    if url.startswith(("http:", "https:")):
        return fetch_url(url)
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))
    with files.open_input_stream(path) as f:
        return _kept(f)


def _kept(stream) -> BinaryIO:
    """What a stream holds, in a temporary file that ends with its handle."""
    kept = tempfile.TemporaryFile()
    shutil.copyfileobj(stream, kept, 1 << 20)
    return kept


def parse_rss(raw: bytes | BinaryIO) -> Iterator[tuple]:
    """(link, title, pubDate, contentSnippet, content) of each item, one at a time.

    The feed is read to its end before this returns, so that a torn one fails and gives none, and again for the items."""
    file = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    file.seek(0)
    for _ in _items(file):
        pass
    return _fields(file)


def _fields(file: BinaryIO) -> Iterator[tuple]:
    file.seek(0)
    for item in _items(file):
        get = item.findtext
        content = get("description")
        snippet = None if content is None else " ".join("".join(ET.fromstring(f"<x>{content}</x>").itertext()).split()) if "<" in content and _whole(content) else content
        yield (get("link"), get("title"), get("pubDate"), snippet, content)


def _items(file: BinaryIO) -> Iterator[ET.Element]:
    """The item elements in order; what was read leaves the tree."""
    above: list[ET.Element] = []
    inside = 0
    for event, element in ET.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(element)
            inside += element.tag == "item"
            continue
        above.pop()
        inside -= element.tag == "item"
        if not inside:
            if element.tag == "item":
                yield from element.iter("item")
            if above:
                del above[-1][-1]


def _whole(content: str) -> bool:
    try:
        ET.fromstring(f"<x>{content}</x>")
        return True
    except ET.ParseError:
        return False


class Feed(InputPartition):
    def __init__(self, number: int, name: str, url: str):
        super().__init__(number)
        self.number, self.name, self.url = number, name, url


class FeedReader(DataSourceReader):
    """One task a feed. A feed that fails gives no item, and a row with the reason where errors are asked for."""

    def __init__(self, feeds: list[list[str]], fetch: Callable[[str], bytes | BinaryIO], errors: bool):
        self.feeds, self.fetch, self.errors = feeds, fetch, errors

    def partitions(self) -> list[Feed]:
        return [Feed(i, name, url) for i, (name, url) in enumerate(self.feeds)]

    def read(self, partition: Feed) -> Iterator[tuple]:
        try:
            rows = parse_rss(self.fetch(partition.url))
        except Exception as e:  # a dead feed must not end the scan of the others
            if self.errors:
                yield (partition.name, partition.number, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for k, row in enumerate(rows):
            yield (partition.name, partition.number, k, *row, None)


class FeedDataSource(DataSource):
    """spark.read.format("feed"): option feeds, a JSON list of [name, url]; errors (false) keeps rows with the reason of failed feeds."""

    fetch: Callable[[str], bytes | BinaryIO] = staticmethod(fetch_url)

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return f"publisher string, source_ord int, item_ord int, {FEED_ITEM}, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(json.loads(self.options["feeds"]), type(self).fetch, self.options.get("errors", "false").lower() == "true")


class FeedFileDataSource(FeedDataSource):
    """The same over files: format "feed_file"."""

    fetch: Callable[[str], bytes | BinaryIO] = staticmethod(fetch_file)

    @classmethod
    def name(cls) -> str:
        return "feed_file"


_REGISTERING = threading.Lock()  # Spark fails where two threads register one name at the same time


def scan_feeds(spark: SparkSession, feeds: list[tuple[str, str]], errors: bool = False, source: type[DataSource] = FeedDataSource) -> DataFrame:
    with _REGISTERING:
        spark.dataSource.register(source)
    return spark.read.format(source.name()).option("feeds", json.dumps(feeds)).option("errors", str(errors).lower()).load()
