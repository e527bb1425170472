import hashlib

import pytest

from tidegauge.llm import mixing as x


def brute_force(rows, schedule, knots, budget):
    """The definition, by bisection on the integral of the shares."""
    count = lambda t: len((t or "").split())
    supply = {}
    for _, s, t in rows:
        supply[s] = supply.get(s, 0) + count(t)
    silent = {s for s, n in supply.items() if not n and (not schedule or max(schedule.get(s, [0])) > 0)}
    supply = {s: n for s, n in supply.items() if n}
    weights = {s: schedule.get(s, [0.0] * len(knots)) if schedule else None for s in supply}
    if not schedule:
        total = sum(supply.values())
        weights = {s: [(n / total) ** t for t in x.TEMPERATURES] for s, n in supply.items()}
    sums = [sum(w[j] for w in weights.values()) for j in range(len(knots))]
    share = {s: [v / z if z else 0 for v, z in zip(w, sums)] for s, w in weights.items()}

    def drawn(s, t):
        area = 0.0
        for j in range(len(knots) - 1):
            hi = min(t, knots[j + 1])
            if hi > knots[j]:
                q0, q1 = share[s][j], share[s][j + 1]
                f = (hi - knots[j]) / (knots[j + 1] - knots[j])
                area += (hi - knots[j]) * (q0 + (q0 + f * (q1 - q0))) / 2
        return area

    if budget is None:
        budget = max(supply[s] / drawn(s, 1) for s in supply if drawn(s, 1) > 0)
    out = [(i, s, 0, 0, 0.0) for i, s, _ in rows if s in silent]
    for s in supply:
        demand = round(budget * drawn(s, 1))
        own = sorted((int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16), i, t) for i, s2, t in rows if s2 == s)
        at = 0
        for _, i, t in own:
            n, e = count(t), 0
            while demand and (at + e * supply[s] < demand if n else e == 0 and at <= demand):
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if drawn(s, mid) * budget < at + e * supply[s] else (lo, mid)
                out.append((i, s, n, e, hi * budget))
                e += 1
            at += n
    return sorted(out, key=lambda r: (r[1] or "", r[0], r[3])), budget


ROWS = [(i, ["a", "b", None][(i % 7) % 3], None if i == 20 else " ".join(["w"] * (i * 37 % 50))) for i in range(120)] + [(200, "silent", None), (201, "silent", " ")]


@pytest.mark.parametrize(
    "schedule, knots, budget",
    [(None, x.KNOTS, None), (None, x.KNOTS, 1000), ({"a": [1, 0], "b": [0, 1], "silent": [5, 5]}, (0.0, 1.0), 2500), ({"a": [1, 5, 0.5, 2], None: [3, 0, 0, 1]}, (0.0, 0.2, 0.9, 1.0), None)],
)
def test_against_bisection(spark, schedule, knots, budget):
    docs = spark.createDataFrame([(i, s, t, 0.5) for i, s, t in ROWS], "doc_id bigint, source string, text string, position double")
    got = [tuple(r) for r in x.mix_plan(docs, schedule=schedule, knots=knots, budget=budget).collect()]
    want, total = brute_force(ROWS, schedule, knots, budget)
    assert [r[4] for r in got] == sorted(r[4] for r in got)
    got.sort(key=lambda r: (r[1] or "", r[0], r[3]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=max(0.01, total * 1e-6))


def test_shares_follow_the_schedule(spark):
    rows = [(i, "ab"[i % 2], "w " * 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = x.mix_plan(docs, schedule={"a": [1, 0], "b": [0, 1]}, knots=(0.0, 1.0), budget=20_000).collect()
    for lo, hi, want in ((0, 5000, 0.875), (5000, 10_000, 0.625), (15_000, 20_000, 0.125)):
        part = [r for r in got if lo <= r.position < hi]
        assert sum(r.tokens for r in part if r.source == "a") / sum(r.tokens for r in part) == pytest.approx(want, abs=0.02)


@pytest.mark.parametrize("small", [True, False])
def test_mix_carries_rows_in_order(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(x, "fits_broadcast", lambda rows, size: False)
    rows = [(i, s, t, f"extra {i}") for i, s, t in ROWS] + [(7, ROWS[7][1], ROWS[7][2], "extra 7"), (None, "b", "x y", "none"), (500, "c", "", "extra 500"), (501, "c", None, "extra 501")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    plan = [(r.doc_id, r.source) for r in x.mix_plan(docs).collect()]
    out = x.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted(plan, key=str)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    position = {}
    for k, p in enumerate(plan):
        position.setdefault(p, []).append(k)
    order = [position[r.doc_id, r.source].pop(0) for r in got]
    assert sum(a > b for a, b in zip(order, order[1:])) <= 8  # equal positions only
    assert all(r.tokens == f"extra {r.doc_id}" for r in got if r.doc_id is not None)


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert x.mix_plan(docs).count() == 0 and x.mix(docs).count() == 0
    only = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id bigint, source string, text string")
    assert sorted(tuple(r) for r in x.mix_plan(only).collect()) == [(1, "a", 0, 0, 0.0), (2, None, 0, 0, 0.0)] and x.mix(only).count() == 2
    with pytest.raises(ValueError):
        x.mix_plan(docs, knots=(0.0, 0.5))
