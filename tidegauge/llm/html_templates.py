"""Text extraction from HTML pages with the site's templates removed.

Every element gets a hash of its subtree (tag, attributes, text with white space collapsed,
the hashes of its children). Spark counts, for each host, on how many pages each hash
occurs. Subtrees that recur on at least MIN_PAGES pages of their host, of whatever size, are
its template; they are deleted, the largest ones whole, and the text of what is
left is extracted, one line a block. Void elements (<br>) are no templates by themselves.
A share of the host's pages can be asked for besides, but then a block of which a large host
has many variants stays.

Parsing is tolerant: unknown or unclosed tags, stray end tags, broken comments. Void
elements have no content; paragraphs, list items, table parts and options end where HTML
says they do; script, style and the like are opaque and give no text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, materialize

MIN_PAGES = 5
MIN_SHARE = 0.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg")}
_SILENT = frozenset("script style template noscript iframe svg head title".split())
_BLOCK = frozenset(
    """address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "caption", "dd", "dt", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
_SCOPE = frozenset("html body table ul ol dl select div article section nav header footer main td th".split())


class Element:
    __slots__ = ("tag", "attributes", "children", "hash")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.hash = tag, attributes, [], 0


def _attributes(raw: str) -> str:
    if not raw or raw.isspace():
        return ""
    return "\x02".join(sorted(f"{k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _ATTRIBUTE.findall(raw)))


def parse(page: str) -> Element:
    """The tree of a page under an artificial root; children are elements and strings."""
    root = Element("", "")
    stack, at = [root], 0

    def open_tags(tags: frozenset | set, stop: frozenset) -> int:
        """Depth of the outermost open element among tags above the nearest one among stop; 0 if none."""
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in stop:
                break
        return found

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside an opaque element
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        raw = m.group(3) if m.group(2) else m.group(6)
        if tag in _CLOSES_P and (k := open_tags({"p"}, _SCOPE)):
            del stack[k:]
        elif (ended := _ENDED_BY.get(tag)) and (k := open_tags(ended, _SCOPE - ended)):
            del stack[k:]
        element = Element(tag, _attributes(raw))
        stack[-1].children.append(element)
        if tag in _VOID or raw.endswith("/"):
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        stack.append(element)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def hash_subtrees(root: Element) -> list[Element]:
    """Sets the hash of every element; returns them, children first. Iterative, for trees of any depth."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if isinstance(c, Element)]
    order.reverse()
    for e in order:
        parts = [e.tag, "\x01", e.attributes]
        for c in e.children:
            if isinstance(c, Element):
                parts.append(f"\x03{c.hash}")
            elif text := _SPACE.sub(" ", c).strip():
                parts.append("\x04" + text)
        e.hash = xxhash.xxh64_intdigest("".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return order[:-1] if order and order[-1] is root else order


def text_of(root: Element, templates: frozenset | set) -> tuple[str, int]:
    """The text outside the template subtrees, and how many of those were cut."""
    out: list[str] = []
    cut = 0
    stack: list = [root]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out.append(e)
        elif e.tag and e.hash in templates:
            cut += 1
            if e.tag in _BLOCK:
                out.append("\n")
        elif e.tag not in _SILENT:
            block = e.tag in _BLOCK
            if block:
                out.append("\n")
                stack.append("\n")
            stack += [c if isinstance(c, Element) else _SPACE.sub(" ", html.unescape(c)) for c in reversed(e.children)]
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), cut


def _distinct_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (html, columns of a page ...) -> (hash, those columns), a row for each different hash of a page."""
    for b in batches:
        pages, hashes = [], []
        for i, page in enumerate(b.column(0)):
            own = {e.hash for e in hash_subtrees(parse(page.as_py() or "")) if e.tag not in _VOID}
            pages += [i] * len(own)
            hashes += own
        rest = [c.take(pa.array(pages, pa.int64())) for c in b.columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *rest], ["hash", *b.schema.names[1:]])


def _among(hashes: list[int], templates: np.ndarray) -> frozenset:
    """Those of a page's hashes that are among its host's sorted templates."""
    own = np.array(hashes, np.int64)
    at = np.minimum(np.searchsorted(templates, own), len(templates) - 1)
    return frozenset(own[templates[at] == own].tolist())


def _extract(shared=None):
    """shared: broadcast host -> sorted templates; without it they come with the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = [], []
            for k, page in enumerate(b.column("html")):
                page = page.as_py()
                if shared is not None:
                    templates = shared.value.get(b.column("host")[k].as_py())
                else:
                    row = b.column("templates")[k]
                    templates = row.values.to_numpy() if row.is_valid else None
                root = parse(page or "")
                order = hash_subtrees(root)
                found = _among([e.hash for e in order], templates) if order and templates is not None else frozenset()
                text, cut = text_of(root, found)
                texts.append(None if page is None else text)
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(texts, pa.string()), pa.array(cuts, pa.int32())], ["page_id", "host", "text", "n_removed"])

    return run


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without port and user; empty for null and for what has no host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash, pages): the template subtrees of each host of pages(url, html)."""
    rows = pages.select(F.col("html").alias("html"), host_of(F.col("url")).alias("host"))
    counts = rows.mapInArrow(_distinct_hashes, "hash bigint, host string").groupBy("host", "hash").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    if not min_share:
        return counts
    sizes = rows.groupBy("host").agg(F.count("*").alias("of"))
    return counts.join(sizes, "host").filter(F.col("pages") >= F.col("of") * min_share).select("host", "hash", "pages")


def extract_without_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, host, text, n_removed of every row of pages(page_id, url, html).

    Null html: null text, nothing removed; empty html: empty text. Pages whose url is null
    or without host count as one host, "". Repeated rows count as pages each. Extra columns are not
    read; an empty table gives none. A long page is parsed whole; the order of hosts or ties plays no part.
    """
    templates = materialize(site_templates(pages, min_pages, min_share))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    result = "page_id bigint, host string, text string, n_removed int"
    if fits_broadcast(templates.count(), 16):
        # by reference: a large host has thousands, too many to stand in each of its rows
        by_host = templates.groupBy(F.col("host").alias("of_host")).agg(F.sort_array(F.collect_list("hash")).alias("templates"))
        got = by_host.toArrow().combine_chunks()
        shared = {h.as_py(): x.values.to_numpy() for h, x in zip(got.column("of_host"), got.column("templates"))}
        return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(shared)), result)
    # each page gets the templates that it holds itself: hashes travel to the templates, then back to the page by its content, so
    # that no host's pages meet in one task; equal pages share a row
    keyed = rows.select("*", F.xxhash64("host", "html").alias("x"), F.xxhash64("host", "html", F.lit(1)).alias("y"))
    held = keyed.select("html", "host", "x", "y").mapInArrow(_distinct_hashes, "hash bigint, host string, x bigint, y bigint")
    met = held.join(templates.select("host", "hash"), ["host", "hash"]).groupBy("x", "y").agg(F.sort_array(F.collect_set("hash")).alias("templates"))
    return keyed.join(met, ["x", "y"], "left").select("page_id", "host", "html", "templates").mapInArrow(_extract(), result)
