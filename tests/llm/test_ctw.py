import math
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import ctw


def brute_force(texts):
    """Bits of each text by the recursive definition, over plain dictionaries."""
    counts = Counter()
    for t in texts:
        padded = b"\0" * ctw.DEPTH + t
        for i in range(ctw.DEPTH, len(padded)):
            for j in range(8):
                prefix, bit = padded[i] >> (8 - j), padded[i] >> (7 - j) & 1
                for d in range(ctw.DEPTH + 1):
                    counts[padded[i - d : i], j, prefix, bit] += 1
    nodes = {k[:3] for k in counts}
    children = {}
    for s, j, u in nodes:
        if s:
            children.setdefault((s[1:], j, u), []).append(s)
    memo = {}

    def kt(s, j, u):
        a, b = counts[s, j, u, 0], counts[s, j, u, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_p(s, j, u):
        if (s, j, u) not in memo:
            k = kt(s, j, u)
            if len(s) < ctw.DEPTH:
                k = float(np.logaddexp(k, sum(log_p(c, j, u) for c in children[s, j, u])) - math.log(2))
            memo[s, j, u] = k
        return memo[s, j, u]

    def prob(context, d, j, u, bit, k):
        s = context[len(context) - d :]
        a, b = counts[s, j, u, 0], counts[s, j, u, 1]
        own = ((b if bit else a) - k + 0.5) / (a + b - k + 1)
        if d == ctw.DEPTH:
            return own
        w = math.exp(kt(s, j, u) - math.log(2) - log_p(s, j, u))
        return w * own + (1 - w) * prob(context, d + 1, j, u, bit, k)

    out = []
    for t in texts:
        padded, bits = b"\0" * ctw.DEPTH + t, 0.0
        own = Counter(padded[i - ctw.DEPTH : i + 1] for i in range(ctw.DEPTH, len(padded)))
        for i in range(ctw.DEPTH, len(padded)):
            for j in range(8):
                bits -= math.log2(prob(padded[i - ctw.DEPTH : i], 0, j, padded[i] >> (8 - j), padded[i] >> (7 - j) & 1, own[padded[i - ctw.DEPTH : i + 1]]))
        out.append(bits)
    return out


TEXTS = ["the cat sat on the mat", "the cat sat on the mat", "ünïcode ñ", "", None, "a", "zzzzzzzzzzzzzzzz" * 20, "the dog sat"]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_matches_brute_force(spark, limit):
    rows = [(i, t, 1.0) for i, t in enumerate(TEXTS)] + [(None, "the cat", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bits double")
    got = {r.doc_id: r for r in ctw.ctw_scores(docs, table_bytes=limit).collect()}
    texts = [t.encode() for _, t, _ in rows if t is not None]
    want = dict(zip([i for i, t, _ in rows if t is not None], brute_force(texts)))
    assert got[4].bits is None and got[4].n_bytes is None and got[4].bits_per_byte is None
    assert got[3].bits == 0 and got[3].n_bytes == 0 and got[3].bits_per_byte is None
    for i, bits in want.items():
        assert got[i].bits == pytest.approx(bits, abs=2e-3)
    assert got[None].n_bytes == 7
    assert got[0].bits == got[1].bits


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_empty_table(spark):
    assert ctw.ctw_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_repetition_costs_less_than_noise(spark):
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(33, 126, 400))
    docs = spark.createDataFrame([(0, "all work and no play " * 19), (1, noise)] + [(2 + i, "all work and no play ") for i in range(50)], "doc_id bigint, text string")
    got = {r.doc_id: r.bits_per_byte for r in ctw.ctw_scores(docs).collect()}
    assert got[0] < 1 < got[1]


def batch(texts):
    return ctw.pa.RecordBatch.from_arrays([ctw.pa.array(range(len(texts)), ctw.pa.int64()), ctw.pa.array(texts, ctw.pa.string())], ["row", "text"])


def test_small_groups_and_early_flushes_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcde "), n)) for n in (0, 5, 3000, 1, 40, 900)] + [None, "é" * 700]

    def counted():
        total = Counter()
        for b in ctw._count([batch(texts).select(["text"]), batch(texts[:3]).select(["text"])]):
            for code, k, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                total[code, k] += n
        return total

    def per_row():
        return sorted(r for b in ctw._grams_per_row([batch(texts)]) for r in zip(*(b.column(i).to_pylist() for i in range(4))))

    whole, rows = counted(), per_row()
    by_row = Counter()
    for _, code, k, n in rows:
        by_row[code, k] += n
    for b in ctw._grams_per_row([batch(texts[:3])]):
        for code, k, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            by_row[code, k] += n
    assert by_row == whole and len(rows) == len(set(r[:2] for r in rows))
    monkeypatch.setattr(ctw, "_GROUP_BYTES", 10)
    monkeypatch.setattr(ctw, "_HELD_GRAMS", 7)
    assert counted() == whole and per_row() == rows


@pytest.mark.parametrize("n, slice_bits", [(1, 22), (1000, 22), (5000, 9), (2_300_000, 22)])
def test_cost_table(tmp_path, monkeypatch, n, slice_bits):
    monkeypatch.setattr(ctw, "_SLICE_BITS", slice_bits)
    rng = np.random.default_rng(n)
    pairs = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    bits = ctw.table_bits(n)
    part = ctw._slot(pairs, bits) >> min(bits, slice_bits)
    order = np.argsort(part, kind="stable")
    rows = [pairs[order] >> np.uint64(24), (pairs[order] & np.uint64(ctw._MOST)).astype(np.int32), pairs[order] * 0.5, part[order].astype(np.int32)]
    whole = ctw.pa.RecordBatch.from_arrays([ctw.pa.array(rows[0].view(np.int64)), *map(ctw.pa.array, rows[1:])], ["code", "k", "cost", "part"])
    made = [r for b in ctw._write_slices(str(tmp_path), bits)([whole.slice(0, n // 3), whole.slice(n // 3)]) for r in zip(*(b.column(i).to_pylist() for i in range(2)))]
    assert len(made) == len(set(part.tolist())) and (n < 5000) == (len(made) == 1)
    table = ctw.CostTable(dict(made), bits)
    asked = rng.choice(pairs, 5000)
    assert (table(asked) == asked * 0.5).all() and len(table(asked[:0])) == 0
    assert n < 5000 or sum(p.stat().st_size for p in tmp_path.iterdir()) <= 80 * n


def test_a_text_is_scored_without_itself(spark):
    """A text of its own kind costs more than one that another text repeats."""
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *odd[:4]])], "doc_id bigint, text string")
    got = {r.doc_id: r.bits_per_byte for r in ctw.ctw_scores(docs).collect()}
    assert max(got[i] for i in range(4)) < min(got[i] for i in range(4, 12)) - 1 and all(got[i] == got[12 + i] for i in range(4))
