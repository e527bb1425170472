"""Media columns: AVI files with motion JPEG, cut into shots.

A file's RIFF tree gives the frame rate and, through an OpenDML index (indx/ix##), the old
index (idx1) or, without either, a walk over LIST movi, the frames of its first video
stream. Every frame is an intra frame: a baseline JPEG, which AVI allows to leave its
Huffman tables out. Frames with the same tables and sizes are decoded side by side: one
NumPy step takes one symbol of every frame. A shot starts where the difference of luminance
histograms of two frames is the highest around and above mean + DEVIATIONS * deviation of
its neighbourhood, and above FLOOR. Shots are clips, with times from the frame rate.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
WINDOW = 8
DEVIATIONS = 3.0
FLOOR = 0.25

_ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22,
     15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def _table(counts: str, symbols: str) -> bytes:
    return bytes.fromhex(counts) + bytes.fromhex(symbols)


#: The typical tables of the JPEG standard (annex K.3), which motion JPEG leaves out: (class << 4 | id) -> counts and symbols.
STANDARD_TABLES = {
    0x00: _table("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: _table("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: _table(
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8"
        "c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: _table(
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


class MediaError(ValueError):
    pass


# --- RIFF -----------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def avi_frames(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second and (offset, length) of the frames of the first video stream; a dropped frame has length 0."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no AVI file")
    stream, rate, movi, idx1, super_index, number = None, 0.0, [], None, None, -1
    micros = 0
    at = 0
    while at + 12 <= len(data) and data[at : at + 4] == b"RIFF":  # OpenDML files have further RIFF AVIX chunks
        size = struct.unpack_from("<I", data, at + 4)[0]
        for kind, start, n in _chunks(data, at + 12, min(len(data), at + 8 + size)):
            if kind == b"LIST" and data[start : start + 4] == b"movi":
                movi.append((start + 4, start + n))
            elif kind == b"idx1":
                idx1 = (start, n)
            elif kind == b"LIST" and data[start : start + 4] == b"hdrl":
                for k2, s2, n2 in _chunks(data, start + 4, start + n):
                    if k2 == b"avih" and n2 >= 4:
                        micros = struct.unpack_from("<I", data, s2)[0]
                    elif k2 == b"LIST" and data[s2 : s2 + 4] == b"strl":
                        number += 1
                        for k3, s3, n3 in _chunks(data, s2 + 4, s2 + n2):
                            if k3 == b"strh" and n3 >= 28 and data[s3 : s3 + 4] == b"vids" and stream is None:
                                scale, per = struct.unpack_from("<II", data, s3 + 20)
                                stream, rate = number, per / scale if scale else 0.0
                            elif k3 == b"indx" and stream == number:
                                super_index = (s3, n3)
        at += 8 + size + (size & 1)
    if stream is None or not movi:
        raise MediaError("no video stream")
    rate = rate or (1e6 / micros if micros else 0.0)
    if not rate:
        raise MediaError("no frame rate")
    ids = {b"%02ddc" % stream, b"%02ddb" % stream}
    if super_index and (found := _open_dml(data, *super_index)) is not None:
        return rate, found
    if idx1:
        found, base = [], None
        for k in range(idx1[1] // 16):
            kind, _, offset, length = struct.unpack_from("<4sIII", data, idx1[0] + 16 * k)
            if kind in ids:
                if base is None:  # offsets count from the word 'movi' or from the file's start
                    base = movi[0][0] - 4 if data[movi[0][0] - 4 + offset :][:4] == kind else 0
                start = base + offset + 8
                found.append((start, length if start + length <= len(data) else 0))
        if found:
            return rate, found
    found = []
    todo = [(s, e) for s, e in reversed(movi)]
    while todo:
        s, e = todo.pop()
        for kind, start, n in _chunks(data, s, e):
            if kind == b"LIST" and data[start : start + 4] == b"rec ":
                todo.append((start + n + (n & 1), e))
                todo.append((start + 4, start + n))
                break
            if kind in ids:
                found.append((start, n))
    return rate, found


def _open_dml(data: bytes, at: int, n: int) -> list[tuple[int, int]] | None:
    per_entry, _, kind, entries = struct.unpack_from("<HBBI", data, at) if n >= 24 else (0, 0, 9, 0)
    found: list[tuple[int, int]] = []
    if kind == 1:  # the frames themselves
        base = struct.unpack_from("<Q", data, at + 12)[0]
        for k in range(entries):
            if at + 24 + 8 * k + 8 > len(data):
                return None
            offset, length = struct.unpack_from("<II", data, at + 24 + 8 * k)
            start, length = base + offset, length & 0x7FFFFFFF
            found.append((start, length if start + length <= len(data) else 0))
        return found
    if kind != 0 or per_entry != 4:
        return None
    for k in range(entries):  # an index of indexes
        if at + 24 + 16 * k + 16 > len(data):
            return None
        offset, size, _ = struct.unpack_from("<QII", data, at + 24 + 16 * k)
        part = _open_dml(data, offset + 8, size - 8) if offset + 32 <= len(data) else None
        if part is None:
            return None
        found += part
    return found or None


# --- JPEG -----------------------------------------------------------------------------


class Frame:
    """A baseline JPEG up to its entropy-coded data."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise MediaError("no JPEG")
        tables, quantisers, self.interval, self.components, self.size = dict(STANDARD_TABLES), {}, 0, [], (0, 0)
        at = 2
        while True:
            while at < len(data) and data[at] == 0xFF and at + 1 < len(data) and data[at + 1] == 0xFF:
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise MediaError("broken JPEG")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide, body_id = body[0] >> 4, body[0] & 15
                    n = 128 if wide else 64
                    if len(body) < 1 + n:
                        raise MediaError("broken JPEG")
                    quantisers[body_id] = bytes(body[1 : 1 + n]) if not wide else struct.unpack(">64H", body[1 : 1 + n])
                    body = body[1 + n :]
            elif marker == 0xC4:
                while len(body) >= 17:
                    n = sum(body[1:17])
                    tables[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, height, width, n = struct.unpack_from(">BHHB", body)
                self.size = (height, width)
                self.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(n)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise MediaError("not a baseline JPEG")
            elif marker == 0xDD:
                self.interval = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                for k in range(body[0]):
                    for c in self.components:
                        if c[0] == body[1 + 2 * k]:
                            c[4], c[5] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                if body[0] != len(self.components) or not body[0]:
                    raise MediaError("not an interleaved scan")
                break
        if 0 in self.size or any(not 1 <= c[1] <= 4 or not 1 <= c[2] <= 4 for c in self.components):
            raise MediaError("broken JPEG")
        try:
            #: What frames must share to be decoded side by side.
            self.kind = (
                self.size, self.interval, tuple(tuple(c[1:3]) for c in self.components), tuple(tuple(quantisers[c[3]]) for c in self.components),
                tuple((tables[c[4]], tables[0x10 | c[5]]) for c in self.components),
            )
        except KeyError:
            raise MediaError("a table is missing") from None
        self.segments = _segments(data, at, bool(self.interval))


def _segments(data: bytes, at: int, restarts: bool) -> list[bytes]:
    """The entropy-coded segments without stuffing, up to the first marker that isn't a restart."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            end = len(data)
            break
        code = data[at + 1]
        if code == 0:
            at += 2
        elif 0xD0 <= code <= 0xD7 and restarts:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at = at + 2
        elif code == 0xFF:
            at += 1
        else:
            end = at
            break
    out.append(data[start:end].replace(b"\xff\x00", b"\xff"))
    return out


_lookups: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: the code's length (0 where there is none) and its symbol."""
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, at = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                lo = code << (16 - length)
                lengths[lo : lo + (1 << (16 - length))] = length
                symbols[lo : lo + (1 << (16 - length))] = table[at] if at < len(table) else 0
                code, at = code + 1, at + 1
            code <<= 1
        _lookups[table] = lengths, symbols
    return _lookups[table]


def decode_luma(frames: list[Frame]) -> tuple[np.ndarray, np.ndarray]:
    """Luminance of frames of one kind (frames x height x width, uint8), and which frames decoded without error."""
    height, width = frames[0].kind[0]
    luma = np.zeros((len(frames), height, width), np.uint8)

    def keep(y: int, x: int, pixels: np.ndarray) -> None:
        luma[:, y : y + 8, x : x + 8] = pixels

    return luma, decode_blocks(frames, keep)


def decode_blocks(frames: list[Frame], keep: Callable[[int, int, np.ndarray], None]) -> np.ndarray:
    """Decodes frames of one kind side by side and gives each luminance block of all of them to keep(y, x, pixels inside
    the picture); returns which frames decoded without error. What is held doesn't grow with the picture's size.

    All components are decoded, as the luminance blocks lie between the others'."""
    (height, width), interval, sampling, quantisers, tables = frames[0].kind
    n = len(frames)
    h_max, v_max = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
    if len(sampling) == 1:  # a scan of one component isn't interleaved: blocks row by row
        sampling, h_max, v_max = ((1, 1),), 1, 1
        across, down = -(-width // 8), -(-height // 8)
    flat = b"".join(b"".join(s + b"\0" * 8 for s in f.segments) for f in frames)
    data = np.frombuffer(flat, np.uint8)
    most = max(len(f.segments) for f in frames)
    starts, limits = np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
    at = 0
    for i, f in enumerate(frames):
        for k in range(most):
            if k < len(f.segments):
                starts[i, k], limits[i, k] = at * 8, (at + len(f.segments[k])) * 8
                at += len(f.segments[k]) + 8
            else:
                starts[i, k] = limits[i, k] = -1
    position, limit = starts[:, 0].copy(), limits[:, 0].copy()
    good = np.ones(n, bool)
    last_byte = len(data) - 4

    def peek(rows: np.ndarray) -> np.ndarray:
        p = position[rows]
        b = np.minimum(p >> 3, last_byte)
        word = (data[b].astype(np.uint32) << np.uint32(16)) | (data[b + 1].astype(np.uint32) << np.uint32(8)) | data[b + 2]
        return (word >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def receive(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """size bits, extended to a signed number."""
        value = (peek(rows) >> (16 - size).astype(np.uint32)).astype(np.int32)
        position[rows] += size
        half = np.left_shift(1, np.maximum(size, 1) - 1)
        return np.where(size == 0, 0, np.where(value < half, value - 2 * half + 1, value))

    def symbol(rows: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ahead = peek(rows)
        length = table[0][ahead]
        bad = length == 0
        if bad.any():
            good[rows[bad]] = False
        position[rows] += length
        return table[1][ahead].astype(np.int32)

    lookups = [(_lookup(dc), _lookup(ac)) for dc, ac in tables]
    predicted = np.zeros((len(sampling), n), np.int32)
    quantiser = np.array(quantisers[0], np.float64)
    everyone = np.arange(n)
    for mcu in range(across * down):
        if interval and mcu and mcu % interval == 0:
            k = mcu // interval
            if k < most:
                position, limit = starts[:, k].copy(), limits[:, k].copy()
                good &= position >= 0
                position[~good] = 0
            else:
                good[:] = False
            predicted[:] = 0
        for c, (h, v) in enumerate(sampling):
            dc, ac = lookups[c]
            for by in range(v):
                for bx in range(h):
                    rows = everyone[good]
                    coefficients = np.zeros((n, 64), np.int32)
                    predicted[c, rows] += receive(rows, np.minimum(symbol(rows, dc), 16))
                    coefficients[rows, 0] = predicted[c, rows]
                    index = np.zeros(n, np.int64)
                    rows = everyone[good]
                    while len(rows):
                        s = symbol(rows, ac)
                        run, size = s >> 4, s & 15
                        index[rows] += np.where((size == 0) & (run < 15), 64, run + 1)
                        inside = index[rows] < 64
                        rows, size = rows[inside], size[inside]
                        coefficients[rows, index[rows]] = receive(rows, size)
                        rows = rows[(index[rows] < 63) & good[rows]]
                    good &= position <= limit
                    if c == 0:
                        block = np.zeros((n, 64))
                        block[:, _ZIGZAG] = coefficients * quantiser
                        pixels = np.matmul(_DCT.T, np.matmul(block.reshape(n, 8, 8), _DCT)) + 128
                        y, x = (mcu // across * v + by) * 8, (mcu % across * h + bx) * 8
                        if y < height and x < width:
                            keep(y, x, np.clip(np.rint(pixels[:, : height - y, : width - x]), 0, 255).astype(np.uint8))
    return good


# --- Shots ----------------------------------------------------------------------------


#: Frames decoded side by side, and bytes of files that are taken at a time.
_SIDE_BY_SIDE, _GROUP_BYTES = 4096, 32 << 20


def histograms(frames: list[bytes | None]) -> list[np.ndarray | None]:
    """Normalised luminance histograms; None for a frame that is missing or can't be decoded."""
    out: list[np.ndarray | None] = [None] * len(frames)
    kinds: dict[tuple, list[tuple[int, Frame]]] = {}
    for i, raw in enumerate(frames):
        try:
            f = Frame(raw or b"")
        except (MediaError, IndexError, struct.error):
            continue
        kinds.setdefault(f.kind, []).append((i, f))
    for kind, members in kinds.items():
        for lo in range(0, len(members), _SIDE_BY_SIDE):
            part = members[lo : lo + _SIDE_BY_SIDE]
            counts, first_bin = np.zeros(len(part) * BINS, np.int64), (np.arange(len(part), dtype=np.int32) * BINS)[:, None, None]

            def count(y: int, x: int, pixels: np.ndarray) -> None:
                nonlocal counts
                counts += np.bincount((first_bin + pixels // (256 // BINS)).reshape(-1), minlength=len(counts))

            good = decode_blocks([f for _, f in part], count)
            for (i, _), own, fine in zip(part, counts.reshape(-1, BINS), good):
                if fine:
                    out[i] = own / (kind[0][0] * kind[0][1])
    return out


def shot_starts(hists: list[np.ndarray | None]) -> list[tuple[int, float]]:
    """(frame, difference to the frame before) of each shot's first frame; the first is (0, 0)."""
    seen = [i for i, h in enumerate(hists) if h is not None]
    if not seen:
        return []
    d = np.array([0.0] + [np.abs(hists[b] - hists[a]).sum() / 2 for a, b in zip(seen, seen[1:])])
    starts = [(0, 0.0)]
    for k in range(1, len(d)):
        lo, hi = max(1, k - WINDOW), min(len(d), k + WINDOW + 1)
        around = np.delete(d[lo:hi], k - lo)
        # cuts nearby would hide this one: the neighbourhood's calm half is what it is compared with
        calm = np.sort(around)[: max(1, (len(around) + 1) // 2)] if len(around) else np.zeros(1)
        highest = d[k] >= max(d[k - 1] if k > 1 else 0, d[k + 1] if k + 1 < len(d) else 0)
        if d[k] > FLOOR and highest and d[k] > calm.mean() + DEVIATIONS * calm.std():
            starts.append((seen[k], float(d[k])))
    return starts


_CLIP = "media_id bigint, clip int, start_frame int, end_frame int, start_s double, end_s double, difference double, error string"
_CLIP_NAMES = [c.split()[0] for c in _CLIP.split(", ")]


def clips_of(files: list[bytes | None]) -> list[list[tuple]]:
    """For each file its clips (clip, start frame, end frame, start, end, difference, error)."""
    parsed: list[tuple[float, list] | str | None] = []
    frames: list[bytes | None] = []
    for data in files:
        if not data:
            parsed.append(None if data is None else "empty")
            continue
        try:
            rate, places = avi_frames(data)
            parsed.append((rate, places))
            frames += [data[s : s + n] if n else None for s, n in places]
        except (MediaError, struct.error) as e:
            parsed.append(str(e) if isinstance(e, MediaError) else "broken AVI file")
    hists, at, out = histograms(frames), 0, []
    for p in parsed:
        if p is None or isinstance(p, str):
            out.append([(None,) * 6 + (p,)] if p else [])
            continue
        rate, n = p[0], len(p[1])
        starts = shot_starts(hists[at : at + n])
        at += n
        if not starts:
            out.append([(None,) * 6 + ("no frame can be decoded",)])
            continue
        ends = [s for s, _ in starts[1:]] + [n]
        out.append([(k, s, e, round(s / rate, 6), round(e / rate, 6), round(d, 6), None) for k, ((s, d), e) in enumerate(zip(starts, ends))])
    return out


def _clip_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lo = 0
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)]
        while lo < b.num_rows:
            hi, held = lo, 0
            while hi < b.num_rows and (hi == lo or held + sizes[hi] <= _GROUP_BYTES):
                held += sizes[hi]
                hi += 1
            ids = b.column(0).slice(lo, hi - lo).to_pylist()
            rows = [(i, *c) for i, clips in zip(ids, clips_of(b.column(1).slice(lo, hi - lo).to_pylist())) for c in clips]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _CLIP_NAMES)
            lo = hi


def detect_shots(media: DataFrame) -> DataFrame:
    """One row for each shot of each file of media(media_id, avi binary): frames [start_frame, end_frame), seconds, and the histogram difference at its start.

    A null file gives no row; an empty or broken one, or one without decodable frames, one
    row with null columns and an error. Frames that are dropped or broken count in time but
    never start a shot. Repeated rows are files of their own; a null media_id stays null;
    other columns are not read; an empty table gives none. A long file is read whole, its frames
    are decoded some thousand at a time.
    """
    return media.select(F.col("media_id").cast("bigint"), "avi").mapInArrow(_clip_batches, _CLIP)


# --- Writing test media -----------------------------------------------------------------


def _codes(table: bytes) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[table[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC, _AC = _codes(STANDARD_TABLES[0x00]), _codes(STANDARD_TABLES[0x10])


def _header(size: int, quantiser: int) -> bytes:
    return (
        b"\xff\xd8\xff\xdb\0\x43\0" + bytes([quantiser] * 64)
        + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, size, size, 1) + b"\x01\x11\0" + b"\xff\xda\0\x08\x01\x01\x00\0\x3f\0"
    )


def grey_jpeg(blocks: list[tuple[int, int, int]], size: int, quantiser: int = 8) -> bytes:
    """A grey motion JPEG frame (without Huffman tables) from (DC, first AC, second AC), quantised, of each 8 x 8 block."""
    bits, count, last = 0, 0, 0
    for dc, *acs in blocks:
        for table, prefix, value in [(_DC, 0, dc - last), *((_AC, 0, a) for a in acs)]:
            if table is _AC and not value:
                break  # the rest of the block is zero
            n = abs(value).bit_length()
            code, length = table[prefix | n]
            bits = bits << length + n | code << n | (value if value >= 0 else value + (1 << n) - 1)
            count += length + n
        code, length = _AC[0]
        bits, count, last = bits << length | code, count + length, dc
    pad = -count % 8
    raw = ((bits << pad) | ((1 << pad) - 1)).to_bytes((count + pad) // 8, "big").replace(b"\xff", b"\xff\0")
    return _header(size, quantiser) + raw + b"\xff\xd9"


def write_avi(frames: list[bytes], rate: int, size: int, index: str = "idx1") -> bytes:
    """An AVI file of one video stream with the index named: idx1, indx (OpenDML) or none."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    places, body = [], b"movi"
    parts = [body]
    at = 4
    for f in frames:
        places.append((at, len(f)))
        parts.append(chunk(b"00dc", f))
        at += len(parts[-1])
    movi = b"".join(parts)
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, len(frames), 0, 1, 0, size, size, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0, 0, 0, size, size)
    strf = struct.pack("<IiiHH4sIiiII", 40, size, size, 1, 24, b"MJPG", size * size * 3, 0, 0, 0, 0)
    streams = chunk(b"strh", strh) + chunk(b"strf", strf)
    indx_size = 24 + 8 * len(frames) if index == "indx" else 0
    before = 12 + 8 + 4 + 8 + len(avih) + 8 + 4 + len(streams) + (8 + indx_size if indx_size else 0)
    movi_at = before + 8  # of the word 'movi'
    if index == "indx":
        entries = b"".join(struct.pack("<II", p + 8, n) for p, n in places)
        streams += chunk(b"indx", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", movi_at, 0) + entries)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + streams))
    tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, p, n) for p, n in places)) if index == "idx1" else b""
    inner = b"AVI " + hdrl + chunk(b"LIST", movi) + tail
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


#: Size and rate of the clips that stand for conversations.
SIDE, RATE = 16, 10


def conversation_avi(turns: list[str]) -> bytes:
    """A clip with one shot for each turn; the turn's text decides the shot's looks and its 4 to 7 frames."""
    frames = []
    for k, text in enumerate(turns):
        seed = hashlib.md5(f"{k}\n{text}".encode("utf-8", "surrogatepass")).digest()
        levels = [(b % 100) + 8 for b in seed[:4]]  # quantised by 8, eight to a grey level
        for f in range(4 + seed[4] % 4):
            blocks = [(level + (seed[5] + f) % 2 - 64, seed[6 + i] % 5 - 2, f % 2) for i, level in enumerate(levels)]
            frames.append(grey_jpeg(blocks, SIDE))
    return write_avi(frames, RATE, SIDE)


def conversation_media(conversations: DataFrame) -> DataFrame:
    """media(media_id, avi) of conversations(conv_id, turn, role, text): one clip a conversation, one shot a turn.

    Turns go by number, null ones first, those with equal or null numbers by text; a null text counts as empty, a long one
    has a shot like any other. Repeated turns are shots of their own. All turns with a null conv_id are one clip of null
    media_id. Other columns are not read; an empty table gives none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [conversation_avi([t["text"] for t in turns]) for turns in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["media_id", "avi"])

    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("bigint").alias("media_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(run, "media_id bigint, avi binary")
