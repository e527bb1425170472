import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import bpe

ENC = bpe.encoder()
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


def naive(piece):
    """Leftmost lowest-rank merge by scanning."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(ENC.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ENC.ranks]
        if not ranked:
            return [ENC.ranks[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_both_trees_equal_scanning(piece):
    want = naive(piece) if piece not in ENC.ranks else [ENC.ranks[piece]]
    assert ENC.merge(piece) == want
    width = bpe._WIDTH_OF[len(piece)]
    if piece not in ENC.ranks:
        assert ENC.merge_all([piece, b"abc", piece], width)[2] == bpe.np.array(want, bpe.np.int32).tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_equals_the_public_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ENC.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and ENC.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 3000 + " 日本" * 2000, " " * 5000, "\x1c\x1d\x85 don't I'LL ½²Ⅷ"])
def test_long_pieces(text):
    assert ENC.encode(text) == REFERENCE.encode_ordinary(text)


def test_table_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = bpe.bpe_encode(docs)
    assert {r.doc_id: r.text for r in bpe.bpe_decode(encoded).collect()} == texts
    for r in bpe.bpe_round_trip(docs).collect():
        assert r.round_trip and r.n_tokens == len(r.token_ids) and r.token_ids == REFERENCE.encode_ordinary(texts[r.doc_id])


def test_odd_rows(spark):
    rows = [(1, None, [1]), (2, "", [1]), (3, "hi", [1]), (3, "hi", [1]), (None, "é", [1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids array<int>")
    got = [(r.doc_id, r.n_tokens, r.token_ids, r.round_trip) for r in bpe.bpe_round_trip(docs).collect()]
    hi, e = REFERENCE.encode_ordinary("hi"), REFERENCE.encode_ordinary("é")
    assert sorted(got, key=str) == sorted([(1, None, None, None), (2, 0, [], True), (3, len(hi), hi, True), (3, len(hi), hi, True), (None, len(e), e, True)], key=str)
    assert sorted(map(str, (r.text for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()))) == sorted(["None", "", "hi", "hi", "é"])
    assert bpe.bpe_encode(docs.limit(0)).count() == 0
