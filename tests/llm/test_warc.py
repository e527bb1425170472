import gzip
import hashlib

import pytest

from tidegauge.llm import warc


def http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in headers) + b"\r\n" + body


CONTENTS = [
    ("warcinfo", "application/warc-fields", b"a: b\r\n"),
    ("response", "application/http; msgtype=response", http(b"plain \r\n\r\nWARC/1.0\r\nbody")),
    ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
    ("response", "application/http", http(gzip.compress(b"zipped" * 5000), b"Content-Encoding: gzip")),
    ("response", "application/http", http(b"4\r\nchun\r\n3;x=y\r\nked\r\n0\r\n\r\n", b"Transfer-Encoding: chunked")),
    ("response", "application/http", http(b"not gzip at all", b"Content-Encoding: gzip")),
    ("metadata", "text/plain", b"x" * 100_000),
    ("response", "application/http", b""),
]
BODIES = [b"a: b\r\n", b"plain \r\n\r\nWARC/1.0\r\nbody", CONTENTS[2][2], b"zipped" * 5000, b"chunked", b"not gzip at all", b"x" * 100_000, b""]


def headers(i):
    return [("WARC-Type", CONTENTS[i][0]), ("WARC-Record-ID", f"<{i}>"), ("Content-Type", CONTENTS[i][1]), ("WARC-Target-URI", f"http://h/{i}"), ("WARC-Date", f"2024-01-0{i + 1}T00:00:00Z")]


@pytest.fixture(params=["plain", "sl", "gzip"])
def file(request, tmp_path):
    parts = [warc.record_bytes(headers(i), c, request.param == "sl") for i, (_, _, c) in enumerate(CONTENTS)]
    path = tmp_path / ("a.warc" if request.param == "plain" else "a.warc.gz")
    path.write_bytes(b"".join(gzip.compress(p) if request.param == "gzip" else p for p in parts))
    return str(path)


def test_records(file):
    rows = list(warc.records(file, lambda h: True, True))
    assert [r["type"] for r in rows] == [c[0] for c in CONTENTS]
    assert [r["payload"] for r in rows] == BODIES
    assert [r["record_id"] for r in rows] == [f"<{i}>" for i in range(len(rows))]


def test_unwanted_payloads_are_not_decoded(file):
    decoded = []
    rows = list(warc.records(file, lambda h: h["warc-type"] == "request", True, decoded))
    assert [r["payload"] for r in rows] == [BODIES[2]] and decoded == [rows[0]["offset"]]
    decoded.clear()
    assert len(list(warc.records(file, lambda h: True, False, decoded))) == len(CONTENTS) and not decoded


def test_cut_file_ends_at_the_last_whole_record(file):
    with open(file, "rb") as f:
        raw = f.read()
    with open(file, "wb") as f:
        f.write(raw[: len(raw) - 30])
    for payload in (True, False):
        rows = list(warc.records(file, lambda h: True, payload))
        assert [r["type"] for r in rows][-1] == "damaged" and "end" in dict(rows[-1]["headers"])["error"]
        assert 5 <= len(rows) - 1 < len(CONTENTS) and [r["type"] for r in rows[:-1]] == [c[0] for c in CONTENTS[: len(rows) - 1]]


def test_pushed_filters():
    from pyspark.sql import datasource as ds

    reader = warc.WarcReader({"path": "x"})
    rest = list(reader.pushFilters([ds.EqualTo(("type",), "response"), ds.StringStartsWith(("target_uri",), "http://h/"), ds.EqualTo(("http_status",), 200), ds.IsNotNull(("date",))]))
    assert [type(r) for r in rest] == [ds.EqualTo] and rest[0].attribute == ("http_status",)
    assert reader.wanted({"warc-type": "response", "warc-target-uri": "http://h/1", "warc-date": "d"})
    assert not reader.wanted({"warc-type": "request", "warc-target-uri": "http://h/1", "warc-date": "d"})
    assert not reader.wanted({"warc-type": "response", "warc-date": "d"})


def test_data_source(spark, file):
    df = warc.read_warc(spark, [file])
    want = sorted(b for (t, _, _), b in zip(CONTENTS, BODIES) if t == "response")
    assert sorted(bytes(r.payload) for r in df.filter("type = 'response'").collect()) == want
    assert df.filter("target_uri like 'http://h/%' and date > '2024-01-03' and type in ('metadata', 'request')").count() == 2
    assert df.filter("http_status = 200").count() == 4
    assert [r.payload for r in warc.read_warc(spark, [file], payload=False, **{"header.WARC-Record-ID": "<3>"}).collect()] == [None]


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/", "<p>é</p>", "x"), (1, "http://a/", "<p>é</p>", "x"), (2, None, "", "x"), (None, "", "x" * 300_000, "x"), (3, "http://b/", None, "x")]
    out = warc.pages_through_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")).collect()
    want = [(i, u, 200, len(h.encode()), hashlib.md5(h.encode()).hexdigest()) for i, u, h, _ in rows if h is not None]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert warc.pages_through_warc(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


FIVE = [(f"<{i}>", b"x" * (1 << 17) if i == 2 else b"body %d" % i) for i in range(5)]


def five(compressed=False, broken=None):
    parts = [warc.record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", name)], body, compressed) for name, body in FIVE]
    return [p.replace(b"WARC/1.0", b"warped!!", 1) if i == broken and not compressed else p for i, p in enumerate(parts)]


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("form", ["plain", "member each", "one member", "two members"])
@pytest.mark.parametrize("broken", [None, 0, 2, 4])
def test_damaged_records_are_reported_and_the_others_read(tmp_path, form, broken, payload):
    parts = five(broken=broken)
    pack = {"plain": lambda: b"".join(parts), "member each": lambda: b"".join(map(gzip.compress, parts)), "one member": lambda: gzip.compress(b"".join(parts)),
            "two members": lambda: gzip.compress(b"".join(parts[:2])) + gzip.compress(b"".join(parts[2:]))}[form]
    path = tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")
    path.write_bytes(pack())
    rows = list(warc.records(str(path), lambda h: True, payload))
    good = [r for r in rows if r["type"] == "resource"]
    assert [(r["record_id"], r["payload"]) for r in good] == [(n, b if payload else None) for i, (n, b) in enumerate(FIVE) if i != broken]
    assert [dict(r["headers"])["error"] for r in rows if r["type"] == "damaged"] == ([] if broken is None else ["no version line"])
    assert [r["record_id"] for r in warc.records(str(path), lambda h: h.get("warc-record-id") == "<3>", payload)] == ["<3>"]


def test_broken_gzip_members(tmp_path):
    parts = five(compressed=True)
    bad = bytearray(parts[2])
    bad[60:80] = b"\xff" * 20
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join([*parts[:2], bytes(bad), *parts[3:], b"\0garbage"]))
    rows = list(warc.records(str(path), lambda h: True, True))
    assert [r["record_id"] for r in rows] == ["<0>", "<1>", None, "<3>", "<4>", None]


def test_damage_through_the_data_source(spark, tmp_path):
    parts = five(broken=1)
    (tmp_path / "x.warc").write_bytes(b"".join(parts) + b"WARC/1.0\r\n" + b"a: b\r\n" * 300_000)
    df = warc.read_warc(spark, [str(tmp_path / "x.warc")])
    assert sorted(r.record_id for r in df.filter("type = 'resource'").collect()) == ["<0>", "<2>", "<3>", "<4>"]
    assert sorted(r.headers["error"] for r in df.filter("type = 'damaged'").collect()) == ["no end of the header block", "no version line"]
    assert df.count() == 6
