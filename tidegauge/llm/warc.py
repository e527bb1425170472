"""WARC files: a Python data source, and a writer.

Reading plans partitions of whole files, packed up to maxPartitionBytes. Predicates on the
record type and on the header columns are taken over from Spark and tested as soon as a
record's header block is parsed. The payload of a record that fails is not decoded: in a
plain file it is skipped by its Content-Length, in a gzip file by the compressed length in
the member's "sl" extra field (WARC 1.0, annex on compression); a member without that field
has to be inflated to find its end, but is thrown away as it comes. HTTP bodies are unchunked
and decompressed for wanted records only. Damage is reported as rows, see records(). A file is one
task, for a payload may hold whole records, which a reader that starts in its middle can't tell
from the file's own; archives are cut into files of about a gigabyte by convention.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .common import filesystem, shared_dir

SCHEMA = (
    "path string, offset bigint, record_id string, type string, target_uri string, date string, content_type string, "
    "headers map<string,string>, http_status int, payload_length bigint, payload binary"
)
_HEADER_COLUMNS = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 1000
_READ = 16 << 10
MAX_HEADER = 1 << 20
MAX_PARTITION_BYTES = 128 << 20


def _parse_block(block: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and the (lower-case name, value) lines of a header block; folded lines are joined."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return lines[0], fields


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decode_http(raw: bytes) -> tuple[int | None, bytes]:
    """Status and decoded body of an HTTP message; what can't be decoded stays as it is."""
    head, sep, body = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return None, raw
    first, fields = _parse_block(head)
    status = next((int(w) for w in first.split()[1:2] if w.isdigit()), None)
    named = dict(fields)
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _unchunk(body)
    try:
        for coding in reversed([c.strip().lower() for c in named.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
    except (OSError, EOFError, zlib.error):
        pass
    return status, body


class _Plain:
    """The bytes of an uncompressed file, from a place that only moves forward."""

    def __init__(self, f):
        self.f, self.size, self.at, self.held = f, f.size(), 0, b""
        f.seek(0)

    @property
    def offset(self) -> int:
        return self.at

    @property
    def ended(self) -> bool:
        return self.at >= self.size

    problem = "the file ends inside a record"

    def peek(self, n: int) -> bytes:
        """At least n of the bytes ahead, fewer at the end only."""
        while len(self.held) < n and (more := self.f.read(max(_READ, n - len(self.held)))):
            self.held += more
        return self.held

    def skip(self, n: int, whole: bool = False) -> bool:
        """Goes on by n bytes; false if there are fewer."""
        there = self.at + n <= self.size
        if n < len(self.held):
            self.held = self.held[n:]
        else:
            self.held = b""
            self.f.seek(min(self.size, self.at + n))
        self.at = min(self.size, self.at + n)
        return there

    def resume(self) -> None:
        """Goes on to the next line that begins like a record, or to the end."""
        self.skip(1)
        while not self.ended:
            ahead = self.peek(_READ)
            found = ahead.find(b"\nWARC/")
            if found >= 0:
                self.skip(found + 1)
                return
            self.skip(max(1, len(ahead) - 5))


class _Gzip:
    """The same for a file of gzip members, whether a member holds one record or many; offset is that of the member."""

    def __init__(self, f):
        self.f, self.size = f, f.size()
        self._open(0)

    def _open(self, at: int) -> None:
        self.offset, self.read_to, self.inner, self.first = at, at, 0, b""
        self.z, self.held, self.problem = zlib.decompressobj(31), bytearray(), ""
        self.f.seek(at)

    @property
    def ended(self) -> bool:
        while self.offset < self.size and not self.problem and not self.peek(1):
            if self.z.eof:
                self._open(self.read_to - len(self.z.unused_data))
        return self.offset >= self.size

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and not self.z.eof and not self.problem:
            raw = self.f.read(_READ)
            self.first = self.first or raw
            self.read_to += len(raw)
            try:
                if not raw:
                    raise zlib.error("the file ends inside a gzip member")
                self.held += self.z.decompress(raw)
            except zlib.error as e:
                self.problem = str(e)
        return self.held

    def _lengths(self) -> tuple[int, int] | None:
        """Compressed and plain length of the member, if its "sl" extra field has them."""
        start = self.first
        if len(start) >= 12 and start[3] & 4:
            extra = start[12 : 12 + struct.unpack("<H", start[10:12])[0]]
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size >= 8:
                    return struct.unpack("<II", extra[4:12])
                extra = extra[4 + size :]
        return None

    def skip(self, n: int, whole: bool = False) -> bool:
        """whole: n bytes are a record, so that a member known to hold no more is left without inflating it."""
        if whole and not self.inner and n > len(self.held) and (lengths := self._lengths()) and lengths[1] == (n + 4) & 0xFFFFFFFF and self.offset + lengths[0] <= self.size:
            self._open(self.offset + lengths[0])
            return True
        self.inner += n
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.peek(1):
                return False
        del self.held[:n]
        return True

    def resume(self) -> None:
        self.skip(1)
        while not self.problem and (ahead := self.peek(_READ)):
            found = ahead.find(b"\nWARC/")
            if found >= 0:
                self.skip(found + 1)
                return
            self.skip(max(1, len(ahead) - 5))
        if not self.problem:
            self._open(self.read_to - len(self.z.unused_data))
            return
        at, tail = self.offset + 1, b""
        while at < self.size:  # the rest of a broken member can't be told from others but by trying
            self.f.seek(at)
            chunk = self.f.read(1 << 20)
            found = chunk.find(b"\x1f\x8b\x08")
            if found < 0:
                at += max(1, len(chunk) - 2)
                continue
            self._open(at + found)
            if self.peek(5)[:5] == b"WARC/":
                return
            at += found + 1
        self._open(self.size)


def records(path: str, wanted: Callable[[dict[str, str]], bool], payload: bool, decoded: list[int] | None = None) -> Iterator[dict]:
    """The records of a file whose headers are wanted.

    What is no whole record (another version line, no length, a header block of over
    MAX_HEADER bytes, a broken gzip member, a cut end) becomes one row of type "damaged" with
    the reason in headers["error"], and reading goes on at the next line, or gzip member,
    that begins like a record. Such rows are wanted or not like others, by their type.
    """
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        magic = f.read(2)
        reader = _Gzip(f) if magic == b"\x1f\x8b" else _Plain(f)
        while not reader.ended:
            ahead = reader.peek(1)
            blank = len(ahead) - len(ahead.lstrip(b"\r\n\0"))
            if blank:
                reader.skip(blank)
                continue
            at, error, end = reader.offset, "", -1
            for n in (_READ, *(MAX_HEADER >> k for k in (4, 2, 0))):
                ahead = reader.peek(n) if end < 0 else ahead
                end = ahead.find(b"\r\n\r\n") if end < 0 else end
            if end < 0:
                error = reader.problem if len(ahead) < MAX_HEADER else "no end of the header block"
                error = error or "no end of the header block"
            else:
                first, fields = _parse_block(bytes(ahead[:end]))
                headers = dict(fields)
                if not first.startswith("WARC/"):
                    error = "no version line"
                elif not headers.get("content-length", "").isdigit():
                    error = "no content length"
            if not error:
                length = int(headers["content-length"])
                row = None
                if wanted(headers):
                    row = {"path": path, "offset": at, "headers": fields, "http_status": None, "payload_length": length, "payload": None}
                    row |= {column: headers.get(header) for column, header in _HEADER_COLUMNS.items()}
                    if payload and len(ahead := reader.peek(end + 4 + length)) >= end + 4 + length:
                        raw = bytes(ahead[end + 4 : end + 4 + length])
                        if decoded is not None:
                            decoded.append(at)
                        if headers.get("content-type", "").lower().startswith("application/http"):
                            row["http_status"], raw = decode_http(raw)
                            row["payload_length"] = len(raw)
                        row["payload"] = raw
                if reader.skip(end + 4 + length, whole=True):
                    if row:
                        yield row
                    continue
                error = reader.problem or "the gzip member ends inside a record"
            reader.resume()
            yield from _damaged(path, at, error, wanted)


def _damaged(path: str, at: int, error: str, wanted: Callable[[dict[str, str]], bool]) -> Iterator[dict]:
    if wanted({"warc-type": "damaged", "error": error}):
        yield dict.fromkeys(_HEADER_COLUMNS) | {"path": path, "offset": at, "type": "damaged", "headers": [("error", error)], "http_status": None, "payload_length": None, "payload": None}


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


_OPERATORS: dict[type, Callable] = {
    ds.EqualTo: lambda v, x: v == x, ds.In: lambda v, x: v in x, ds.StringStartsWith: lambda v, x: v.startswith(x),
    ds.StringEndsWith: lambda v, x: v.endswith(x), ds.StringContains: lambda v, x: x in v,
    ds.GreaterThan: lambda v, x: v > x, ds.GreaterThanOrEqual: lambda v, x: v >= x, ds.LessThan: lambda v, x: v < x, ds.LessThanOrEqual: lambda v, x: v <= x,
}


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        named = {k.lower(): v for k, v in options.items()}
        self.paths = json.loads(named["paths"]) if "paths" in named else [named["path"]]
        self.payload = named.get("payload", "true").lower() == "true"
        self.max_bytes = int(named.get("maxpartitionbytes", MAX_PARTITION_BYTES))
        #: (header, name of the operator's class, value)
        self.tests: list[tuple[str, str, object]] = [(k[len("header.") :], "EqualTo", v) for k, v in named.items() if k.startswith("header.")]

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            header = _HEADER_COLUMNS.get(column[0]) if len(column) == 1 else None
            if header and type(f) in _OPERATORS and f.value is not None:
                self.tests.append((header, type(f).__name__, f.value))
            elif header and isinstance(f, ds.IsNotNull):
                self.tests.append((header, "IsNotNull", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        sized = []
        for path in self.paths:
            fs, name = filesystem(path)
            info = fs.get_file_info(name)
            if info.type == pafs.FileType.Directory:
                prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
                sized += [(prefix + i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if i.type == pafs.FileType.File and ".warc" in i.base_name]
            elif info.type == pafs.FileType.File:
                sized.append((path, info.size))
            else:
                raise FileNotFoundError(path)
        packed: list[list[str]] = []
        held = self.max_bytes
        for path, size in sorted(sized, key=lambda x: (-x[1], x[0])):
            if held + size > self.max_bytes:
                packed.append([])
                held = 0
            packed[-1].append(path)
            held += size
        return [Files(p) for p in packed]

    def wanted(self, headers: dict[str, str]) -> bool:
        operators = {k.__name__: v for k, v in _OPERATORS.items()}
        for header, operator, value in self.tests:
            have = headers.get(header)
            if have is None or operator != "IsNotNull" and not operators[operator](have, value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("path",)] + [("offset", pa.int64())] + [(n, pa.string()) for n in ("record_id", "type", "target_uri", "date", "content_type")]
            + [("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload_length", pa.int64()), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for path in partition.paths:
            for r in records(path, self.wanted, self.payload):
                r["headers"] = list(dict(r["headers"]).items())
                rows.append(r)
                held += len(r["payload"] or b"")
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(ds.DataSource):
    """spark.read.format("warc"): options path or paths (a JSON list), payload (true), maxPartitionBytes, header.<name> (equals)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, paths: list[str], payload: bool = True, **options: str) -> DataFrame:
    """The records of WARC files and folders: see SCHEMA. No file, or files without records, give an empty table.

    Spark keeps the reader of a table for its next plan unless that plan has a filter to push
    down, so predicates of one query would stay in force in the next one over the same
    DataFrame; the filter that is always true makes every plan ask for a new reader."""
    register(spark)
    return spark.read.format("warc").option("paths", json.dumps(paths)).option("payload", str(payload).lower()).options(**options).load().filter("offset >= 0")


def record_bytes(headers: list[tuple[str, str]], content: bytes, compressed: bool = True) -> bytes:
    """One record; compressed, as a gzip member with its lengths in an "sl" extra field."""
    clean = [(k, " ".join(v.split("\r\n")).replace("\r", "%0D").replace("\n", "%0A")) for k, v in headers]
    raw = "WARC/1.0\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in clean).encode("utf-8", "replace") + f"Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"
    if not compressed:
        return raw
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\x03" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        fs, path = filesystem(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with fs.open_output_stream(path, compression=None) as f:
            date = [("WARC-Date", "2024-01-01T00:00:00Z")]
            f.write(record_bytes([("WARC-Type", "warcinfo"), *date, ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n"))
            for b in batches:
                for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                    common = [*date] + ([("WARC-Target-URI", url)] if url is not None else []) + ([("X-Page-Id", str(page_id))] if page_id is not None else [])
                    if html is not None:
                        body = html.encode("utf-8", "surrogatepass")
                        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                        f.write(record_bytes([("WARC-Type", "response"), *common, ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/http; msgtype=response")], http))
                    note = f"htmlBytes: {-1 if html is None else len(body)}\r\n".encode()
                    f.write(record_bytes([("WARC-Type", "metadata"), *common, ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], note))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "pages"])

    return run


def write_warc(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages(page_id, url, html), one file a task, and returns the files of the tasks that counted.

    A page gives a response record and a metadata record; null html gives the latter only, a null url or
    page_id leaves its header out. Files of failed or doubled attempts stay in the folder unlisted."""
    listed = pages.select(pages["page_id"].cast("bigint"), "url", "html").mapInArrow(_write(folder), "path string, pages bigint")
    return sorted(r.path for r in listed.collect())


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Pages written as WARC and read again: page_id, url, http_status, n_bytes, digest of every response record.

    Pages with null html have no response and no row; null page_id and url stay null; repeated rows are
    records of their own; extra columns are not written; an empty table gives none."""
    spark = pages.sparkSession
    paths = write_warc(pages, f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    found = read_warc(spark, paths, maxPartitionBytes=str(16 << 20)).filter("type = 'response'")
    return found.selectExpr("cast(headers['x-page-id'] as bigint) as page_id", "target_uri as url", "http_status", "payload_length as n_bytes", "md5(payload) as digest")
