import pytest

from tidegauge.llm import html_templates as h


def tree(e):
    return [e.tag, *[tree(c) if isinstance(c, h.Element) else c for c in e.children]]


def test_tolerant_parsing():
    assert tree(h.parse("<p>a<p>b<br>c</div></p><ul><li>x<li>y</ul>d")) == ["", ["p", "a"], ["p", "b", ["br"], "c"], ["ul", ["li", "x"], ["li", "y"]], "d"]
    assert tree(h.parse("<script>if (a < b) '</p>'</script><b>x")) == ["", ["script", "if (a < b) '</p>'"], ["b", "x"]]
    assert tree(h.parse("a < b <!-- <p> --> <a title='>'>c</a><")) == ["", "a < b ", " ", ["a", "c"], "<"]
    assert tree(h.parse("<table><tr><td>1<td>2<tr><td>3</table>")) == ["", ["table", ["tr", ["td", "1"], ["td", "2"]], ["tr", ["td", "3"]]]]
    assert tree(h.parse("")) == [""]


def test_hash_ignores_layout_only():
    def first(page):
        root = h.parse(page)
        h.hash_subtrees(root)
        return root.children[0].hash

    assert first("<div class=a id='b'><p>x  y</p></div>") == first('<DIV id="b"\n class="a">\n<p> x y </p></DIV>')
    assert first("<div><p>x</p></div>") != first("<div><b>x</b></div>") != first("<div>x</div>")


def test_depth_is_no_limit():
    root = h.parse("<div>" * 50_000 + "x")
    assert len(h.hash_subtrees(root)) == 50_000
    assert h.text_of(root, set())[0] == "x"


def brute_force(rows, min_pages, min_share):
    """Every page against every other of its host."""
    trees = []
    for _, host, page in rows:
        root = h.parse(page or "")
        trees.append((host, root, {e.hash for e in h.hash_subtrees(root) if e.tag != "br"}))
    out = []
    for host, root, own in trees:
        peers = [s for other, _, s in trees if other == host]
        out.append(h.text_of(root, {x for x in own if (n := sum(x in s for s in peers)) >= min_pages and n >= min_share * len(peers)}))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(h, "fits_broadcast", lambda rows, size: False)
    nav = "<nav><ul><li><a href='/a'>Home</a><li>News</ul></nav>"
    rows = []
    for i in range(30):
        host = "abc"[i % 3]
        page = f"<html><head><title>t{i}</title></head><body>{nav if host != 'c' or i < 6 else ''}<div>text {i}<br>more &amp; {i % 7}</div><p>shared {i % 4}</p><footer>&copy; {host}</footer>"
        rows.append((i, host, page))
    rows += [(30, "a", None), (31, "a", ""), (None, "a", rows[0][2]), (0, "a", rows[0][2])]
    docs = [(i, f"https://{host}/p/{i}", page, "x") for i, host, page in rows]
    got = h.extract_without_templates(spark.createDataFrame(docs, "page_id bigint, url string, html string, text string"), 5, 0.2).collect()
    want = [(i, host, None if page is None else t, n) for (i, host, page), (t, n) in zip(rows, brute_force(rows, 5, 0.2))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    texts = {r.page_id: r.text for r in got if r.page_id is not None}
    assert "Home" not in texts[1] and "text 1" in texts[1] and "Home" in texts[2] and "more & 1" in texts[1]


def test_urls_without_host(spark):
    rows = [(1, None, "<p>x</p>"), (2, "nothing", "<p>x</p>"), (3, "https://u:p@H.x:80/y", "<p>x</p>")]
    out = {r.page_id: (r.host, r.text) for r in h.extract_without_templates(spark.createDataFrame(rows, "page_id bigint, url string, html string"), 2, 0).collect()}
    assert out == {1: ("", ""), 2: ("", ""), 3: ("h.x", "x")}
    assert h.extract_without_templates(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_many_variants_on_a_large_host(spark, monkeypatch):
    """60 navigations and advertisements used evenly: each on 1.67 % of the pages of a host of any size."""
    page = lambda i: f"<html><body><nav><ul><li>Menu {i % 60}<li>Home</ul></nav><div class=ad>Buy {i * 7 % 60}</div><article><p>own {i}</p></article></body></html>"
    rows = [(i, f"http://{'large' if i < 1200 else 'small'}.x/{i}", page(i)) for i in range(1440)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    large = lambda: {(r.page_id, r.text) for r in h.extract_without_templates(pages).collect() if r.host == "large.x"}
    assert large() == {(i, f"own {i}") for i in range(1200)}
    monkeypatch.setattr(h, "fits_broadcast", lambda rows, size: False)
    assert large() == {(i, f"own {i}") for i in range(1200)}
