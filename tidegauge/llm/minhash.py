"""Near-duplicate groups by b-bit MinHash.

Signature: the low BITS bits of the minima of PERMUTATIONS hash functions over a text's
word shingles, packed into bytes. Candidates: rows that agree on all full minima of one of
BANDS bands. Verification: similarity from the count of agreeing b-bit slots, corrected for
the chance 2^-b that two different minima share their low bits. Groups: the connected
components of the verified pairs.

No bucket is capped. Inside a bucket a breadth-first search compares each reached row only
with the rows not reached yet, so a bucket of m near copies takes about m comparisons and
still yields exactly the components that all m^2 pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits_broadcast, materialize

SHINGLE_WORDS = 3
PERMUTATIONS = 160
BANDS = 40
BITS = 4
#: Two texts are near copies from this estimated Jaccard similarity of their shingles. One word in ten replaced leaves 0.57;
#: the estimate's deviation is 0.04 there, and 40 bands of 4 find such a pair with probability 0.99.
SIMILAR_FROM = 0.45
#: Bytes of text hashed at a time; bounds memory whatever the length of a text.
CHUNK_BYTES = 1 << 20
#: Rows of a bucket that one comparison holds in memory at most, twice; a larger bucket is compared part with part.
PART_ROWS = 100_000

_ROWS = PERMUTATIONS // BANDS
SIGNATURE_BYTES = PERMUTATIONS * BITS // 8
_U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_XOR = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BAND_MUL = _rng.integers(0, 1 << 63, _ROWS, dtype=np.uint64) * _U64(2) + _U64(1)
#: Byte -> lower case where it belongs to a word (ASCII letters and digits, all of non-ASCII), else 0.
_WORD_BYTE = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        _WORD_BYTE[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c
_NONE = np.uint32(0xFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in a byte array."""
    low = _WORD_BYTE[data]
    inside = np.empty(len(low) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(low, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * up[: len(low)], out=sums[1:])
    return starts, _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the runs of SHINGLE_WORDS words; [i] starts at word i."""
    n = len(hashes) - SHINGLE_WORDS + 1
    out = hashes[:n].copy()
    for k in range(1, SHINGLE_WORDS):
        out = out * _U64(0xD6E8FEB86659FD93) + hashes[k : n + k]
    return (_mix(out) >> _U64(32)).astype(np.uint32)


def _minima(shingles: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
    """Minima of each run shingles[first[i]:first[i + 1]] under each function, into out (rows x functions)."""
    step = 1 << 15
    for lo in range(0, len(first), step):
        hi = min(lo + step, len(first))
        part = shingles[first[lo] : first[hi] if hi < len(first) else len(shingles)]
        at, buf = first[lo:hi] - first[lo], np.empty(len(part), np.uint32)
        for j in range(PERMUTATIONS):
            np.bitwise_xor(part, _XOR[j], out=buf)
            np.multiply(buf, _MUL[j], out=buf)
            out[lo:hi, j] = np.minimum.reduceat(buf, at)


def minima(texts: list[bytes]) -> np.ndarray:
    """Full 32-bit minima of each text; rows of texts without any word are all ones."""
    out = np.full((len(texts), PERMUTATIONS), _NONE, np.uint32)
    group: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK_BYTES:
            out[i] = _long_minima(t)
            continue
        if held + len(t) > CHUNK_BYTES and group:
            _group_minima(texts, group, out)
            group, held = [], 0
        group.append(i)
        held += len(t) + 1
    if group:
        _group_minima(texts, group, out)
    return out


def _group_minima(texts: list[bytes], group: list[int], out: np.ndarray) -> None:
    data = np.frombuffer(b"\n".join(texts[i] for i in group), np.uint8)
    if not len(data):
        return
    begin = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in group])])
    starts, hashes = words_of(data)
    bounds = np.searchsorted(starts, begin)
    counts = np.diff(bounds)
    ids = np.asarray(group)
    if len(hashes) >= SHINGLE_WORDS:
        sh = _shingles(hashes)
        full = counts >= SHINGLE_WORDS
        keep = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(keep, bounds[:-1][full], 1)
        np.add.at(keep, bounds[1:][full] - SHINGLE_WORDS + 1, -1)
        inside = np.cumsum(keep[: len(sh)]) > 0
        kept = sh[inside]
        if len(kept):
            first = np.concatenate([[0], np.cumsum(counts[full] - SHINGLE_WORDS + 1)[:-1]])
            part = np.empty((int(full.sum()), PERMUTATIONS), np.uint32)
            _minima(kept, first, part)
            out[ids[full]] = part
    for g in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):  # shorter than a shingle: one shingle of all words
        h = hashes[bounds[g] : bounds[g + 1]]
        x = np.uint32(int(_mix(np.array([np.bitwise_xor.reduce(h * (np.arange(len(h), dtype=np.uint64) * _U64(2) + _U64(3)))], np.uint64))[0]) >> 32)
        out[ids[g]] = (x ^ _XOR) * _MUL


def _long_minima(text: bytes) -> np.ndarray:
    """Minima of one text longer than a chunk: chunks overlap by all but one word of a shingle."""
    best, tail, at = np.full(PERMUTATIONS, _NONE, np.uint32), b"", 0
    while at < len(text):
        end = min(len(text), at + CHUNK_BYTES)
        while end < len(text) and _WORD_BYTE[text[end]] and _WORD_BYTE[text[end - 1]]:
            end += 1
        part = tail + text[at:end]
        starts, hashes = words_of(np.frombuffer(part, np.uint8))
        if len(hashes) >= SHINGLE_WORDS:
            got = np.empty((1, PERMUTATIONS), np.uint32)
            _minima(_shingles(hashes), np.zeros(1, np.int64), got)
            np.minimum(best, got[0], out=best)
            tail = part[starts[-(SHINGLE_WORDS - 1)] :]
        else:
            tail = part
        at = end
    if (best == _NONE).all() and tail:
        out = np.full((1, PERMUTATIONS), _NONE, np.uint32)
        _group_minima([tail], [0], out)
        return out[0]
    return best


def pack(mins: np.ndarray) -> np.ndarray:
    """Low BITS bits of the minima, slot after slot, as rows of SIGNATURE_BYTES bytes."""
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(mins), PERMUTATIONS * BITS), axis=1, bitorder="little")


def band_keys(mins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band, from the full minima."""
    m = mins.reshape(len(mins), BANDS, _ROWS).astype(np.uint64)
    key = np.zeros(m.shape[:2], np.uint64)
    for r in range(_ROWS):
        key = _mix(key + m[:, :, r] * _BAND_MUL[r] + _U64(r + 1))
    return _mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_SLOT_MASK = _U64(sum(1 << (BITS * i) for i in range(64 // BITS)))


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one packed signature (as uint64 words) with many."""
    diff = others ^ one
    for s in (1, 2):  # BITS is 4: any differing bit of a slot ends up in its lowest bit
        diff = diff | (diff >> _U64(s))
    agree = 1.0 - np.bitwise_count(diff & _SLOT_MASK).sum(axis=1) / PERMUTATIONS
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def bucket_forest(sigs: np.ndarray, threshold: float = SIMILAR_FROM) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the graph of pairs with similarity >= threshold."""
    left, edges = np.arange(len(sigs)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = similarity(sigs[i], sigs[left]) >= threshold
            if near.any():
                reached = left[near]
                left = left[~near]
                edges += [(i, int(j)) for j in reached]
                queue += reached.tolist()
    return edges


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
            mins = minima(texts)
            some = ~(mins == _NONE).all(axis=1)
            ids = part.column(0).to_numpy(zero_copy_only=False)[some]
            mins = mins[some]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(mins) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(mins).reshape(-1)))
            sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGNATURE_BYTES), len(mins), [None, pa.py_buffer(np.ascontiguousarray(pack(mins)).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), sigs.cast(pa.binary()), keys], ["node", "sig", "keys"])


def signatures(rows: DataFrame) -> DataFrame:
    """node, sig, keys of rows(node bigint, text string); rows without any word give none."""
    return rows.mapInArrow(_signatures, "node bigint, sig binary, keys array<bigint>")


def _forest_of_runs(threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (key, node, sig) sorted by key -> the edges found in each run of one key.

    A union-find over the edges of the task drops those that close a cycle in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        def close(nodes: np.ndarray, sigs: np.ndarray) -> None:
            order = np.argsort(nodes, kind="stable")
            nodes, sigs = nodes[order], sigs[order]
            for i, j in bucket_forest(sigs, threshold):
                a, b = root(int(nodes[i])), root(int(nodes[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((min(a, b), max(a, b)))

        def table() -> pa.RecordBatch:
            ab = np.array(edges, np.int64).reshape(-1, 2)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        keys, nodes, sigs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SIGNATURE_BYTES // 8), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            # the last run of what came before may go on in this batch
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            nodes = np.concatenate([nodes, b.column(1).to_numpy()])
            sigs = np.concatenate([sigs, np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)])
            cuts = np.flatnonzero(np.diff(keys)) + 1
            begin = np.concatenate([[0], cuts])
            for r in np.flatnonzero(np.diff(begin) > 1):
                close(nodes[begin[r] : begin[r + 1]], sigs[begin[r] : begin[r + 1]])
            keys, nodes, sigs = keys[begin[-1] :], nodes[begin[-1] :], sigs[begin[-1] :]
            if len(edges) > 50_000:
                yield table()
        if len(nodes) > 1:
            close(nodes, sigs)
        yield table()

    return run


def _shared_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, node) sorted by key, node -> (bucket, node, size) of the keys with several nodes; bucket is a hash of its set of nodes.

    Copies meet in many bands; buckets of the same nodes get the same hash, and a task lists each once."""
    seen: set[int] = set()
    keys, nodes = np.empty(0, np.int64), np.empty(0, np.int64)

    def found(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        size = np.diff(np.append(begin, len(keys)))
        hashed = _mix(nodes.view(np.uint64))
        bucket = _mix(np.add.reduceat(hashed, begin) + size.astype(np.uint64)).view(np.int64)
        new = np.zeros(len(begin), bool)
        for r in np.flatnonzero(size > 1):
            h = int(bucket[r])
            if h not in seen:
                seen.add(h)
                new[r] = True
        rows = np.repeat(new, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, size)[rows]), pa.array(nodes[rows]), pa.array(np.repeat(size, size)[rows])], ["bucket", "node", "size"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, nodes = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([nodes, b.column(1).to_numpy()])
        last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if last:
            yield from found(keys[:last], nodes[:last])
            keys, nodes = keys[last:], nodes[last:]
        if len(seen) > 1_000_000:
            seen.clear()
    if len(keys):
        yield from found(keys, nodes)


def near_edges(sigs: DataFrame, threshold: float = SIMILAR_FROM) -> DataFrame:
    """Edges (a, b), a < b, that connect the near copies among sigs(node, sig, keys).

    Rows of one signature hang on the least of them, which alone is banded. Only keys and nodes
    go through the large shuffle; signatures follow for the nodes that share a bucket. A bucket
    of more than PART_ROWS is cut by hash and each two parts are compared in a group of their own."""
    sigs = materialize(sigs)
    same = materialize(sigs.groupBy("sig").agg(F.min("node").alias("rep"), F.min_by("keys", "node").alias("keys")))
    digest = [F.xxhash64("sig").alias("x"), F.xxhash64("sig", F.lit(1)).alias("y")]
    equal = sigs.select("node", *digest).join(same.select("rep", *digest), ["x", "y"]).filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    banded = same.select(F.explode("keys").alias("key"), F.col("rep").alias("node"))
    shared = banded.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared_buckets, "bucket bigint, node bigint, size bigint")
    shared = shared.repartition("bucket").distinct()
    parts = F.ceil(F.col("size") / PART_ROWS)
    own = F.pmod(F.xxhash64("node"), parts)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    shared = shared.select(F.explode(F.when(parts > 1, pairs).otherwise(F.array("bucket"))).alias("bucket"), "node")
    runs = shared.join(same.select(F.col("rep").alias("node"), "sig"), "node").select("bucket", "node", "sig")
    runs = runs.repartition("bucket").sortWithinPartitions("bucket")
    return equal.unionByName(runs.mapInArrow(_forest_of_runs(threshold), "a bigint, b bigint")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of edges(a, b).

    Alternating large-star and small-star steps; each round is cut by a checkpoint in the shared
    folder. A node of many edges is split over tasks by the adaptive join on its least neighbour."""
    edges = materialize(edges.select("a", "b").filter("a <> b"))
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = Window.partitionBy("a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every edge now runs from the larger to the smaller node
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def near_groups(docs: DataFrame, threshold: float = SIMILAR_FROM) -> DataFrame:
    """(node, root) of the rows of docs(doc_id, text) that have a near copy; node = xxhash64(doc_id, text)."""
    return components(near_edges(signatures(_with_node(docs).select("node", "text")), threshold))


def _ranked(docs: DataFrame, threshold: float) -> DataFrame:
    """One row for each distinct (node, doc_id): how many rows it stands for, whether it is the one its group keeps, and the group."""
    one = docs.select(F.xxhash64("doc_id", "text").alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"))
    one = one.groupBy("node", "doc_id").agg(F.count("*").alias("copies"))
    members = one.join(near_groups(docs, threshold), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    groups = members.groupBy("root").agg(first, F.sum("copies").alias("group_rows"))
    found = members.join(groups, "root").select(
        F.col("node").alias("m_node"), F.col("doc_id").alias("m_id"), F.col("first.doc_id").alias("group_id"), "group_rows", ((F.col("node") == F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("best")
    )
    joined = one.join(found, (F.col("node") == F.col("m_node")) & F.col("doc_id").eqNullSafe(F.col("m_id")), "left")
    grouped = F.col("m_node").isNotNull()
    return joined.select(
        "node", "doc_id", "copies", F.coalesce("best", F.lit(True)).alias("best"), F.when(grouped, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"), F.coalesce("group_rows", "copies").alias("group_rows")
    )


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR_FROM) -> DataFrame:
    """doc_id, group_id, group_rows, kept for every row of docs(doc_id, text).

    group_id is the least doc_id of the row's group, and the row with it is kept (ties: the
    row of the least hash). Rows without near copy form groups of their own. Texts that are
    null, empty or without any word have no near copies; long ones are hashed whole, in chunks. Rows alike in doc_id and text are
    copies, whatever the text, and one is kept; rows that share only the doc_id are separate
    rows. A null doc_id sorts after all others. Other columns are not read; an empty table
    gives none.
    """
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    rows = _ranked(docs, threshold).select("doc_id", "group_id", "group_rows", "best", copy)
    return rows.select("doc_id", "group_id", "group_rows", (F.col("best") & (F.col("copy") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILAR_FROM) -> DataFrame:
    """The rows of docs that near_duplicates keeps, all columns as they are.

    Null, empty and word-less texts stay unless their row is repeated whole in doc_id and text; of
    repeated rows one stays; columns of any other name are carried along; an empty table gives none."""
    node, mark = "__minhash_node__", "__minhash_mark__"
    marks = materialize(
        _ranked(docs, threshold)
        .filter("not best or copies > 1")
        .select(F.col("node").alias(node + "of"), F.col("doc_id").alias(mark + "id"), (~F.col("best")).alias(mark))
    )
    n, repeated = marks.agg(F.count("*"), F.count_if(~F.col(mark))).first()
    side = F.broadcast(marks) if fits_broadcast(n, 32) else marks
    hashed = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    same = (F.col(node) == F.col(node + "of")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(mark + "id"))
    joined = hashed.join(side, same, "left")
    kept = joined.filter(F.col(mark).isNull()).select(docs.columns)
    if repeated:
        kept = kept.unionByName(joined.filter(~F.col(mark)).dropDuplicates([node, mark + "id"]).select(docs.columns))
    return kept
