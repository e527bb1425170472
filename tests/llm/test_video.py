import struct

import numpy as np
import pytest

from tidegauge.llm import video as v


def slow_decode(frame):
    """A plain scalar decoder of luminance: one frame, bit by bit."""
    (height, width), interval, sampling, quantisers, tables = v.Frame(frame).kind
    segments = v.Frame(frame).segments
    if len(sampling) == 1:
        sampling = ((1, 1),)
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    codes = [[{(length, code): s for s, (code, length) in v._codes(t).items()} for t in pair] for pair in tables]
    out = np.zeros((down * 8 * sampling[0][1], across * 8 * sampling[0][0]))
    bits, at, last = "", 0, [0] * len(sampling)

    def take(n):
        nonlocal at
        at += n
        return bits[at - n : at]

    def symbol(table):
        word = ""
        while (len(word), int(word or "0", 2)) not in table:
            word += take(1)
        return table[len(word), int(word, 2)]

    def number(n):
        if not n:
            return 0
        x = int(take(n), 2)
        return x if x >> (n - 1) else x - (1 << n) + 1

    for mcu in range(across * down):
        if mcu == 0 or interval and mcu % interval == 0:
            bits, at, last = "".join(f"{x:08b}" for x in segments[mcu // interval if interval else 0]), 0, [0] * len(sampling)
        for c, (h, w) in enumerate(sampling):
            for by in range(w):
                for bx in range(h):
                    z = [0] * 64
                    last[c] += number(symbol(codes[c][0]))
                    z[0], k = last[c], 1
                    while k < 64:
                        s = symbol(codes[c][1])
                        if s == 0:
                            break
                        k += s >> 4
                        z[k] = number(s & 15)
                        k += 1
                    if c == 0:
                        m = np.zeros(64)
                        m[v._ZIGZAG] = np.array(z) * np.array(quantisers[0])
                        y, x = (mcu // across * w + by) * 8, (mcu % across * h + bx) * 8
                        out[y : y + 8, x : x + 8] = v._DCT.T @ m.reshape(8, 8) @ v._DCT + 128
    return np.clip(np.rint(out), 0, 255)[:height, :width]


def coded(rng, size, sampling, interval):
    """A random baseline JPEG with several components, runs of zeros and restarts."""
    bits, pieces, named = [], [], sampling
    sampling = ((1, 1),) if len(sampling) == 1 else sampling  # the blocks of a single component aren't interleaved
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mcus = (-(-size[1] // (8 * hm))) * (-(-size[0] // (8 * vm)))
    last = [0] * len(sampling)

    def put(table, symbol, value, n):
        code, length = table[symbol]
        bits.append(f"{code:0{length}b}" + (f"{value if value >= 0 else value + (1 << n) - 1:0{n}b}" if n else ""))

    def flush():
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        pieces.append(bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0"))
        bits.clear()

    for mcu in range(mcus):
        if interval and mcu and mcu % interval == 0:
            flush()
            last = [0] * len(sampling)
        for c, (h, w) in enumerate(sampling):
            dct, act = v._codes(v.STANDARD_TABLES[c > 0]), v._codes(v.STANDARD_TABLES[0x10 | (c > 0)])
            for _ in range(h * w):
                d = int(rng.integers(-40, 41))
                put(dct, abs(d - last[c]).bit_length(), d - last[c], abs(d - last[c]).bit_length())
                last[c], k = d, 1
                while k < 64 and rng.random() < 0.9:
                    run = int(rng.integers(0, 20))
                    while run > 15 and k + 16 < 64:
                        put(act, 0xF0, 0, 0)
                        run, k = run - 16, k + 16
                    run = min(run, 15)
                    if k + run > 63:
                        break
                    x = int(rng.choice([-9, -2, -1, 1, 3, 30]))
                    n = abs(x).bit_length()
                    put(act, run << 4 | n, x, n)
                    k += run + 1
                if k < 64:
                    put(act, 0, 0, 0)
    flush()
    head = b"\xff\xd8\xff\xdb\0\x43\0" + bytes(range(1, 65)) + (b"\xff\xdd\0\x04" + struct.pack(">H", interval) if interval else b"")
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(sampling), 8, *size, len(sampling)) + b"".join(bytes([c + 1, h << 4 | w, 0]) for c, (h, w) in enumerate(named))
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(sampling), len(sampling)) + b"".join(bytes([c + 1, 0x11 * (c > 0)]) for c in range(len(sampling))) + b"\0\x3f\0"
    return head + b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(pieces) - 1 else b"") for i, p in enumerate(pieces)) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [((1, 1),), ((2, 2),), ((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("interval", [0, 2])
def test_decoder_equals_a_scalar_one(sampling, interval):
    rng = np.random.default_rng(5)
    frames = [coded(rng, (21, 35), sampling, interval) for _ in range(4)]
    luma, good = v.decode_luma([v.Frame(f) for f in frames])
    assert good.all()
    for f, got in zip(frames, luma):
        assert np.abs(got.astype(int) - slow_decode(f)).max() <= 1


@pytest.mark.parametrize("index", ["idx1", "indx", "none"])
def test_indexes(index):
    frames = [v.grey_jpeg([(k, 1, 0)] * 4, 16) for k in range(5)]
    data = v.write_avi(frames, 25, 16, index)
    rate, places = v.avi_frames(data)
    assert rate == 25 and [data[s : s + n] for s, n in places] == frames


def test_shots_are_the_turns(spark):
    turns = [(c, t, "user", f"turn {t} of conversation {c}" * (t + 1), "x") for c in range(40) for t in range(1 + c % 5)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, clip string")
    got = {}
    for r in v.detect_shots(v.conversation_media(df)).collect():
        assert r.error is None and r.start_s == r.start_frame / v.RATE and r.end_s == r.end_frame / v.RATE
        got.setdefault(r.media_id, []).append((r.start_frame, r.end_frame))
    right = total = 0
    for c in range(40):
        texts = [t[3] for t in turns if t[0] == c]
        ends = np.cumsum([4 + v.hashlib.md5(f"{k}\n{t}".encode()).digest()[4] % 4 for k, t in enumerate(texts)]).tolist()
        want = list(zip([0, *ends[:-1]], ends))
        total += len(want)
        right += len(set(want) & set(got[c]))
    assert right >= 0.97 * total


def test_shots_against_the_definition():
    rng = np.random.default_rng(6)
    frames = []
    for _ in range(6):
        level = rng.integers(-50, 50, 4)
        frames += [v.grey_jpeg([(int(x), 1, int(rng.integers(0, 2))) for x in level], 16) for _ in range(int(rng.integers(2, 9)))]
    hists = [np.bincount((slow_decode(f) // 8).astype(int).reshape(-1), minlength=32) / 256 for f in frames]
    fast = v.histograms(frames)
    assert all(np.abs(a - b).sum() < 0.1 for a, b in zip(hists, fast))
    assert [s for s, _ in v.shot_starts(hists)] == [s for s, _ in v.shot_starts(fast)]


def test_odd_files(spark):
    frame = v.grey_jpeg([(0, 0, 0)] * 4, 16)
    good = v.write_avi([frame] * 3, 10, 16)
    holes = v.write_avi([frame, b"", frame[:40], frame], 10, 16)
    rows = [(1, None, 0), (2, b"", 0), (3, b"RIFFxxxx", 0), (4, good, 0), (4, good, 0), (None, holes, 0), (5, v.write_avi([b"x"], 10, 16), 0), (6, good[:60], 0)]
    rows = [(i, bytearray(b) if b is not None else None, c) for i, b, c in rows]
    got = sorted(((r.media_id or 0, r.end_frame, r.error) for r in v.detect_shots(spark.createDataFrame(rows, "media_id bigint, avi binary, clip int")).collect()), key=str)
    assert got == [(0, 4, None), (2, None, "empty"), (3, None, "no AVI file"), (4, 3, None), (4, 3, None), (5, None, "no frame can be decoded"), (6, None, "no video stream")]
    assert v.detect_shots(spark.createDataFrame([], "media_id bigint, avi binary")).count() == 0


def test_histograms_of_partial_blocks():
    """Pictures whose size is no multiple of a block, many at once: counted as from the whole picture."""
    rng = np.random.default_rng(8)
    frames = [coded(rng, (21, 35), ((2, 2), (1, 1), (1, 1)), 0) for _ in range(5)]
    luma, good = v.decode_luma([v.Frame(f) for f in frames])
    assert luma.shape == (5, 21, 35) and good.all()
    for got, pixels in zip(v.histograms(frames), luma):
        assert (got == np.bincount(pixels.reshape(-1) // (256 // v.BINS), minlength=v.BINS) / pixels.size).all()


def test_odd_conversations(spark):
    rows = [(None, 1, "u", "x"), (None, None, "u", None), (2, 1, "u", "a"), (2, 1, "u", "a"), (3, 1, "u", "long " * 100_000), (4, None, None, "")]
    media = v.conversation_media(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.media_id: len(v.avi_frames(bytes(r.avi))[1]) for r in media.collect()}
    assert got.keys() == {None, 2, 3, 4} and all(4 <= got[k] <= 7 for k in (3, 4)) and got[None] >= 8 and got[2] >= 8
    assert v.detect_shots(media).filter("error is not null").count() == 0
    assert v.conversation_media(spark.createDataFrame([], "conv_id bigint, turn bigint, text string")).count() == 0
