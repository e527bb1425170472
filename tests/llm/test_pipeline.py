"""The pipeline's stages against brute-force versions of them, one after the other."""

import random

import corpus_pipeline
from tests.llm.test_bpe import REFERENCE
from tests.llm.test_minhash import edited, jaccard, prose
from tests.llm.test_mixing import brute_force as brute_mix
from tidegauge.llm import mixing, toxicity
from tidegauge.llm.minhash import SIMILAR_FROM


def make(rng):
    rows = []
    for g in range(60):
        base = prose(rng, rng.randint(40, 150))
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            text = edited(rng, base, rng.randint(0, 2))
            if rng.random() < 0.1:
                words = text.split()
                words.insert(rng.randrange(len(words)), "idiot")
                text = " ".join(words)
            rows.append([len(rows), text, "en", f"src{rng.choice([0, 0, 0, 1, 2])}", len(text)])
    rows += [[len(rows), None, None, "src1", None], [len(rows) + 1, "", "en", "src0", 0], [None, "some words without number", "en", None, 25], [3, rows[3][1], "en", rows[3][3], rows[3][4]]]
    return [tuple(r) for r in rows]


def brute_force(rows):
    rows = [r for r in rows if toxicity.score_text(r[1])[0] < toxicity.REJECT_FROM]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][:2] == rows[j][:2] or jaccard(rows[i][1] or "", rows[j][1] or "") >= SIMILAR_FROM:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    kept = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    plan, _ = brute_mix([(r[0], r[3], r[1]) for r in kept], None, mixing.KNOTS, None)
    texts = {(r[0], r[3]): r[1] for r in kept}
    return [(p[4], p[0], None if texts[p[0], p[1]] is None else REFERENCE.encode_ordinary(texts[p[0], p[1]])) for p in plan]


def test_stages_against_brute_force(spark, tmp_path):
    rows = make(random.Random(11))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = [(r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = sorted(brute_force(rows), key=lambda r: r[0])
    assert sorted(out, key=str) == sorted(((i, t) for _, i, t in want), key=str)
    place = {}
    for position, i, _ in want:
        place.setdefault(i, []).append(position)
    order = [place[i].pop(0) for i, _ in out]
    assert all(b - a > -0.01 for a, b in zip(order, order[1:]))


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0


def test_training_order_through_several_files(spark, tmp_path):
    """Files of unequal size, which Spark reads in another order than they were written in."""
    rows = [(i, f"w{i} " * (1 + i % 7 * 5), "en", f"src{i % 3}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    padded = [(k, i, text + " pad" * (k // 100 * 200)) for k, (i, text) in enumerate(mixed)]
    path = str(tmp_path / "mixed")
    by_place = spark.createDataFrame(padded, "k bigint, doc_id bigint, text string").repartitionByRange(6, "k").sortWithinPartitions("k")
    by_place.select("doc_id", "text").write.parquet(path)
    again = spark.read.parquet(path)
    assert len(again.inputFiles()) == 6 and [r.doc_id for r in again.collect()] != [i for i, _ in mixed]
    out = corpus_pipeline.bpe(spark, again, str(tmp_path)).collect()
    assert [r.position for r in out] == list(range(len(mixed)))
    assert [(r.doc_id, r.token_ids) for r in out] == [(i, REFERENCE.encode_ordinary(text)) for _, i, text in padded]
    assert corpus_pipeline.bpe(spark, again.limit(0), str(tmp_path)).count() == 0


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """No rows, and columns of the names that the stages use themselves."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, position double, node string, kept int, score string, tokens string, root array<int>"
    names = [c.split()[0] for c in columns.split(", ")]
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "a quiet text of some words"), (1, "a quiet text of some words"), (2, "you pathetic idiot"), (3, None), (4, ""), (None, "another text entirely, of words"), (5, long), (6, long + " end")]
    spark.createDataFrame([(i, t, None, "s", None, 0.5, "n", 1, "x", None, [1]) for i, t in rows], columns).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([1, 3, 4, None, 5], key=str)
    assert {r.doc_id: r.n_tokens for r in out}[5] > 60_000
