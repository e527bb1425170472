"""Byte-pair encoding and decoding with public vocabularies.

A piece of text is split into bytes; a segment tree over the ranks of adjacent pairs keeps,
in its root, the lowest rank and among equal ranks the leftmost pair. Merging it changes at
most three leaves, each updated in logarithmic time, until the root holds no pair that the
vocabulary can merge. Work on one piece of n bytes is O(n log n), so unbroken runs of any
length are fine. Pieces of up to 64 bytes are worked on side by side, one tree each, in
NumPy arrays. Pieces repeat a lot; a worker remembers a bounded number of them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file: lines of base64 token and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on ASCII text, for the faster standard module (whose \s has 1c-1f besides, as regex's has).
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_UNICODE = regex.compile(PATTERN)
#: Pieces remembered by a worker (then it starts afresh).
REMEMBERED = 300_000
#: Sizes of the trees that are worked on side by side; longer pieces get a tree of their own.
_WIDTHS = (8, 16, 32, 64)
_WIDTH_OF = [next(w for w in _WIDTHS if n <= w) for n in range(_WIDTHS[-1] + 1)]
_INF = 1 << 62
_FIB = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """Open-addressed table from a pair of token ids to the rank of what they join to."""
        ranks, pairs = self.ranks, []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        keys, values = np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int32)
        bits = (4 * max(1, len(pairs)) - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slot_keys = np.full((1 << bits) + 64, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.slot_ranks = np.full((1 << bits) + 64, -1, np.int32)
        slots = ((keys * _FIB) >> self.shift).astype(np.int64)
        for s, k, v in zip(slots.tolist(), keys, values):
            while self.slot_ranks[s] >= 0:
                s += 1
            self.slot_keys[s], self.slot_ranks[s] = k, v

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, -1 where the vocabulary has none."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = ((key * _FIB) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            at = slot[todo]
            hit = self.slot_keys[at] == key[todo]
            out[todo[hit]] = self.slot_ranks[at[hit]]
            todo = todo[~hit & (self.slot_ranks[at] >= 0)]
            slot[todo] += 1
        return out

    def merge_all(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids (as int32 bytes) of many pieces of at most width bytes: one segment tree each, in step."""
        n, levels, none = len(pieces), width.bit_length() - 1, np.int32(0x7FFFFFFF)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = np.full((n, width + 1), -1, np.int32)
        token[:, :width] = self.byte_ids[raw]
        token[:, :width][np.arange(width) >= lengths[:, None]] = -1
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        np.minimum(after, lengths[:, None].astype(np.int32), out=after)
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * width), none, np.int32)
        row, col = np.nonzero(np.arange(width - 1) < lengths[:, None] - 1)
        r = self.pair_ranks(token[row, col], token[row, col + 1])
        some = r >= 0
        tree[row[some], width + col[some]] = r[some] * np.int32(width) + col[some].astype(np.int32)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        flat = tree.reshape(-1)

        def put(words: np.ndarray, leaves: np.ndarray, values: np.ndarray) -> None:
            base, node = words * (2 * width), leaves + width
            flat[base + node] = values
            for _ in range(levels):
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        def rated(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            r = self.pair_ranks(token[words, left], token[words, right])
            return np.where(r >= 0, r * np.int32(width) + left.astype(np.int32), none)

        live = np.flatnonzero(tree[:, 1] != none)
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = after[live, i]
            nxt = after[live, j]
            token[live, i] = root // width
            token[live, j] = -1
            after[live, i] = nxt
            put(live, j, np.full(len(live), none, np.int32))
            more = nxt < lengths[live]
            value = np.full(len(live), none, np.int32)
            w, left, right = live[more], i[more], nxt[more]
            before[w, right] = left
            value[more] = rated(w, left, right)
            put(live, i, value)
            p = before[live, i]
            some = p >= 0
            w, left, right = live[some], p[some], i[some]
            put(w, left, rated(w, left, right))
            live = live[tree[live, 1] != none]
        kept = token[:, :width] >= 0
        ids = token[:, :width][kept].tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        part = [piece[i : i + 1] for i in range(n)]
        shift = n.bit_length()
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_INF] * (2 * size)
        mask = (1 << shift) - 1
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (root := tree[1]) < _INF:
            i = root & mask
            j = after[i]
            part[i] += part[j]
            part[j] = b""
            nxt = after[i] = after[j]
            if j < n - 1:
                put(j, _INF)
            if nxt < n:
                before[nxt] = i
                r = ranks.get(part[i] + part[nxt])
                put(i, _INF if r is None else r << shift | i)
            else:
                put(i, _INF)
            p = before[i]
            if p >= 0:
                r = ranks.get(part[p] + part[i])
                put(p, _INF if r is None else r << shift | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of an int32 array."""
        split = [_ASCII.findall(t) if t.isascii() else _UNICODE.findall(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        by_width: dict[int, list[tuple[str, bytes]]] = {w: [] for w in _WIDTHS}
        long: dict[str, bytes] = {}
        for piece in new.difference(known):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > _WIDTHS[-1]:
                long[piece] = np.array(self.merge(raw), np.int32).tobytes()
            else:
                by_width[_WIDTH_OF[len(raw)]].append((piece, raw))
        for width, group in by_width.items():
            for lo in range(0, len(group), 8192):
                part = group[lo : lo + 8192]
                known.update(zip([p for p, _ in part], self.merge_all([raw for _, raw in part], width)))
        known.update(long)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in long:
            del known[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("a token id outside the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Characters of text encoded at a time.
_GROUP_CHARS = 1_000_000


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about _GROUP_CHARS bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
    lo = 0
    while lo < b.num_rows:
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + _GROUP_CHARS, "right")))
        yield lo, hi - lo
        lo = hi


def _encode_batches(path: str, check: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = ["doc_id", "n_tokens", "token_ids"] + ["round_trip"] * check
        for b in batches:
            for lo, n in _groups(b):
                texts = b.column(1).slice(lo, n).to_pylist()
                ids = enc.encode_many([t or "" for t in texts])
                counts = np.array([len(x) // 4 for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=pa.array(null) if null.any() else None)
                columns = [b.column(0).slice(lo, n), pa.array(counts, mask=null), lists]
                if check:
                    same = [enc.decode(np.frombuffer(x, np.int32)) == (t or "").encode() for x, t in zip(ids, texts)]
                    columns.append(pa.array(same, pa.bool_(), mask=null))
                columns += [c.slice(lo, n) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names + b.schema.names[2:])

    return run


_ENCODED = "doc_id bigint, n_tokens int, token_ids array<int>"


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, token_ids of every row of docs(doc_id, text).

    A null text gives null tokens, an empty one none; repeated rows are encoded each; a null
    doc_id stays null; a long text is encoded whole; other columns are not read; an empty table
    gives none. vocabulary is a file that every executor has.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_encode_batches(vocabulary, False), _ENCODED)


def bpe_encode_placed(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """bpe_encode's columns and position (bigint) of docs(doc_id, text, position), range-sorted by position.

    Cases as in bpe_encode; rows of equal position come in any order, those of a null one first."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.col("position").cast("bigint").alias("position")).orderBy("position")
    return rows.mapInArrow(_encode_batches(vocabulary, False), _ENCODED + ", position bigint")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of every row of encoded(doc_id, token_ids): the inverse of bpe_encode.

    Null ids give a null text. Bytes that are no UTF-8 (token lists that were cut) become
    U+FFFD; an id outside the vocabulary raises an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "token_ids").mapInArrow(run, "doc_id bigint, text string")


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """bpe_encode's columns and round_trip: whether decoding the tokens gives the text's bytes back (null for a null text).

    Cases as in bpe_encode."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_encode_batches(vocabulary, True), _ENCODED + ", round_trip boolean")
