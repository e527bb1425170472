"""Language-model scoring by context-tree weighting over bytes.

Every byte is coded as eight binary decisions, most significant bit first. A decision is
named by the bits of its byte before it; for each there is a context tree whose contexts
are the DEPTH bytes before, nearest first. A node s holds counts (a, b) of zeros and ones
from the whole corpus, the Krichevsky-Trofimov block probability

    K(a, b) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1))

and the weighted probability P(s) = K/2 + prod(P(children))/2, at depth DEPTH P(s) = K. The
next bit's probability mixes the estimates of all depths along its context, node s with
posterior weight K/2 / P(s) against what lies deeper. A text's code length is the sum of
-log2 over its bits; its score is bits per byte. Before a text's first byte stand DEPTH zero
bytes.

A text is not scored by itself: where it has a gram (DEPTH bytes of context and the next
byte) k times, those k are taken off the counts of every node on the gram's path, so the
estimate for the bit taken is (n - k + 1/2) / (a + b - k + 1). The posterior weights are
those of the whole corpus.

Distribution: tasks count the grams of all documents by how often a document has them, a
shuffle adds them up, and since the code length of a byte depends on (gram, k) alone, it is
worked out once for each. Trees below two context bytes are split over tasks; the two upper
levels are at most 256 x 255 nodes and are finished on the driver. The code lengths are
written into the shared folder as slices of one hash table, which workers map into memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, scratch_path

DEPTH = 4
#: Bytes of the table of code lengths up to which workers look them up in it; a larger model is joined by gram.
TABLE_BYTES = 1 << 29
#: Slots of a slice of the table, as a power of two: 64 MB.
_SLICE_BITS = 22
#: Own occurrences of a gram that a text's count is told apart up to; beyond, so many are taken off.
_MOST = (1 << 24) - 1
_GROUP_BYTES = 2 << 20
#: Distinct grams that a task holds before it passes them on.
_HELD_GRAMS = 2_000_000
_U64 = np.uint64
_FIB = _U64(0x9E3779B97F4A7C15)
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln G(x) for x > 0: Stirling's series after shifting x above 8."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    series, power = np.zeros_like(x), 1 / x
    for c in _STIRLING:
        series += c * power
        power = power / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of all bytes (nearest context byte first, then farther ones, then the byte) and each text's first index."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(len(data) - DEPTH, _U64)
    for k in range(1, DEPTH + 1):
        code <<= _U64(8)
        code |= data[DEPTH - k : len(data) - k]
    code <<= _U64(8)
    code |= data[DEPTH:]
    if len(texts) > 1:
        real = np.ones(len(code), bool)
        ends = np.cumsum(lengths + DEPTH)[:-1]
        real[(ends[:, None] - np.arange(1, DEPTH + 1)).reshape(-1)] = False
        code = code[real]
    return code, np.concatenate([[0], np.cumsum(lengths)])


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Rows in groups of about _GROUP_BYTES of text; null as empty."""
    texts, held, first = [], 0, 0
    for i, t in enumerate(column):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        texts.append(raw)
        held += len(raw)
        if held >= _GROUP_BYTES:
            yield first, texts
            texts, held, first = [], 0, i + 1
    if texts:
        yield first, texts


def _add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def _row_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and count of the distinct grams of each of fewer than 2^24 texts."""
    code, begin = grams_of(texts)
    key = np.repeat(np.arange(len(texts), dtype=np.uint64) << _U64(40), np.diff(begin)) | code
    key.sort()
    first = _runs(key) if len(key) else np.empty(0, np.int64)
    return (key[first] >> _U64(40)).astype(np.int64), key[first] & _U64((1 << 40) - 1), np.diff(np.append(first, len(key)))


def _pair(code: np.ndarray, k: np.ndarray) -> np.ndarray:
    return code << _U64(24) | np.minimum(k, _MOST).astype(np.uint64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, counts, held = [], [], 0

    def table() -> pa.RecordBatch:
        pair, n = _add_up(pairs, counts) if pairs else (np.empty(0, _U64), np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array((pair >> _U64(24)).view(np.int64)), pa.array((pair & _U64(_MOST)).astype(np.int32)), pa.array(n)], ["code", "k", "n"])

    for b in batches:
        for _, texts in _pieces(b.column(0)):
            _, code, k = _row_grams(texts)
            if not len(code):
                continue
            pair, n = _add_up([_pair(code, k)], [k])
            pairs.append(pair)
            counts.append(n)
            held += len(pair)
            if held > _HELD_GRAMS:
                merged = _add_up(pairs, counts)
                pairs, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > _HELD_GRAMS // 2:
                    yield table()
                    pairs, counts, held = [], [], 0
    yield table()


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(code, k, n): how often each gram occurs in all the texts that have it k times."""
    return docs.select("text").mapInArrow(_count, "code bigint, k int, n bigint").groupBy("code", "k").agg(F.sum("n").alias("n"))


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


class _Level:
    """The nodes of one depth and bit over sorted gram keys: sorted node keys with log K, log P and the counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int, deeper: "_Level | None", context_bits: int):
        self.nodes_of_grams = keys >> _U64(8 - bit)
        ones = (keys >> _U64(7 - bit)) & _U64(1)
        first = _runs(self.nodes_of_grams)
        self.keys = self.nodes_of_grams[first]
        total = np.add.reduceat(n, first)
        self.b = np.add.reduceat(n * ones.astype(np.int64), first)
        self.a = total - self.b
        kt = log_kt(self.a, self.b)
        if deeper is None:
            self.log_p, self.weight = kt, np.ones(len(kt))
            return
        # a deeper key has the context's farthest byte between the rest of the context and the bits
        parent = ((deeper.keys >> _U64(8 + bit)) << _U64(bit)) | (deeper.keys & _U64((1 << bit) - 1))
        below = np.zeros(len(kt))
        np.add.at(below, np.searchsorted(self.keys, parent), deeper.log_p)
        self.log_p = np.logaddexp(kt, below) - np.log(2)
        self.weight = np.exp(kt - np.log(2) - self.log_p)


def _subtrees(code: np.ndarray, n: np.ndarray) -> list[list[_Level]]:
    """Levels [depth - 2][bit] of the trees under whole two-byte contexts, for sorted codes."""
    levels: list[list[_Level]] = []
    deeper: list[_Level] | None = None
    for depth in range(DEPTH, 1, -1):
        drop = _U64(8 * (DEPTH - depth))
        keys = (code >> (drop + _U64(8))) << _U64(8) | (code & _U64(255))
        order = np.argsort(keys, kind="stable")
        keys, m = keys[order], n[order]
        first = _runs(keys)
        keys, m = keys[first], np.add.reduceat(m, first)
        own = [_Level(keys, m, bit, deeper[bit] if deeper else None, depth * 8) for bit in range(8)]
        levels.insert(0, own)
        deeper = own
    return levels


def _whole_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (code, k, n) in chunks that hold whole two-byte contexts."""
    top = _U64(8 * (DEPTH - 1))
    code, k, n = np.empty(0, _U64), np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        code = np.concatenate([code, b.column(0).to_numpy().view(_U64)])
        k = np.concatenate([k, b.column(1).to_numpy()])
        n = np.concatenate([n, b.column(2).to_numpy()])
        if len(code) > 200_000:
            first = _runs(code >> top)
            if (at := first[-1]) > 0:
                yield code[:at], k[:at], n[:at]
                code, k, n = code[at:], k[at:], n[at:]
    if len(code):
        yield code, k, n


def _trees(code: np.ndarray, n: np.ndarray) -> list[list[_Level]]:
    first = _runs(code)
    return _subtrees(code[first], np.add.reduceat(n, first))


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per two-byte context and bit: node (first byte, bit name), its counts and log P."""
    for code, _, n in _whole_contexts(batches):
        for bit, level in enumerate(_trees(code, n)[0]):
            first_byte = (level.keys >> _U64(8 + bit)).astype(np.int32)
            name = (level.keys & _U64((1 << bit) - 1)).astype(np.int32) | (1 << bit)
            yield pa.RecordBatch.from_arrays([pa.array(first_byte), pa.array(name), pa.array(level.a), pa.array(level.b), pa.array(level.log_p)], ["c", "node", "a", "b", "p"])


class _Upper:
    """Depths 1 and 0: arrays [context byte][bit name] and [bit name] of weight and counts."""

    def __init__(self, rows: Iterable):
        self.a, self.b, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for c, node, a, b, p in rows:
            self.a[c, node], self.b[c, node], below[c, node] = a, b, p
        seen = self.a + self.b > 0
        kt = log_kt(self.a, self.b)
        p1 = np.where(seen, np.logaddexp(kt, below) - np.log(2), 0.0)
        self.weight = np.where(seen, np.exp(kt - np.log(2) - p1), 1.0)
        self.a0, self.b0 = self.a.sum(axis=0), self.b.sum(axis=0)
        kt0 = log_kt(self.a0, self.b0)
        p0 = np.logaddexp(kt0, p1.sum(axis=0)) - np.log(2)
        self.weight0 = np.exp(kt0 - np.log(2) - p0)


def _costs(upper: _Upper, table_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, k, n in _whole_contexts(batches):
            levels = _trees(code, n)
            c1 = (code >> _U64(8 * DEPTH)).astype(np.int64)
            byte = code & _U64(255)
            bits = np.zeros(len(code))
            for bit in range(8):
                one = ((byte >> _U64(7 - bit)) & _U64(1)).astype(bool)
                name = (byte >> _U64(8 - bit)).astype(np.int64) | (1 << bit)

                def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    return (np.where(one, b, a) - k + 0.5) / (a + b - k + 1.0)

                p = None
                for depth in range(DEPTH, 1, -1):
                    level = levels[depth - 2][bit]
                    context = code >> _U64(8 * (DEPTH - depth) + 8)
                    at = np.searchsorted(level.keys, (context << _U64(bit)) | (byte >> _U64(8 - bit)))
                    kt = estimate(level.a[at], level.b[at])
                    p = kt if p is None else level.weight[at] * kt + (1 - level.weight[at]) * p
                w = upper.weight[c1, name]
                p = w * estimate(upper.a[c1, name], upper.b[c1, name]) + (1 - w) * p
                w = upper.weight0[name]
                p = w * estimate(upper.a0[name], upper.b0[name]) + (1 - w) * p
                bits -= np.log2(p)
            part = _slot(_pair(code, k), table_bits) >> min(table_bits, _SLICE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(bits), pa.array(part.astype(np.int32))], ["code", "k", "cost", "part"])

    return run


def gram_costs(grams: DataFrame, table_bits: int = 8) -> DataFrame:
    """(code, k, cost, part): the code length in bits of each gram of grams(code, k, n) in a text that has it k times, and its slice of a table of 2^table_bits slots."""
    two = F.shiftright("code", 8 * (DEPTH - 1))
    placed = grams.repartition(two).sortWithinPartitions("code", "k")
    roots = placed.mapInArrow(_roots, "c int, node int, a bigint, b bigint, p double")
    upper = _Upper(roots.groupBy("c", "node").agg(F.sum("a"), F.sum("b"), F.sum("p")).collect())
    return placed.mapInArrow(_costs(upper, table_bits), "code bigint, k int, cost double, part int")


def table_bits(n: int) -> int:
    """Slots of the table, as a power of two: two to four for each of n entries."""
    return max(8, (2 * max(1, n) - 1).bit_length())


def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs * _FIB) >> _U64(64 - bits)).astype(np.int64)


def pack_slice(pairs: np.ndarray, costs: np.ndarray, bits: int) -> bytes:
    """A slice of the table: keys and values by slot; entries whose slot is taken stand in a sorted rest behind."""
    size = 1 << min(bits, _SLICE_BITS)
    slot = _slot(pairs, bits) & (size - 1)
    _, first = np.unique(slot, return_index=True)
    keys, values = np.full(size, 0xFFFFFFFFFFFFFFFF, _U64), np.zeros(size)
    keys[slot[first]], values[slot[first]] = pairs[first], costs[first]
    rest = np.ones(len(pairs), bool)
    rest[first] = False
    order = np.argsort(pairs[rest])
    return b"".join(x.tobytes() for x in (keys, values, pairs[rest][order], costs[rest][order]))


class CostTable:
    """Costs by (gram, k), from the slices of the table in the shared folder: mapped into memory where that is a file
    system of the machine, else read."""

    def __init__(self, slices: dict[int, str], bits: int):
        self.slices, self.bits = {}, bits
        size = 1 << min(bits, _SLICE_BITS)
        for part, path in slices.items():
            fs, name = filesystem(path)
            if fs.type_name == "local":
                raw = np.memmap(name, np.uint8, "r")
            else:
                with fs.open_input_file(name) as f:
                    raw = np.frombuffer(f.read(), np.uint8)
            keys, values, rest = raw[: 8 * size], raw[8 * size : 16 * size], raw[16 * size :]
            half = len(rest) // 2
            self.slices[part] = keys.view(_U64), values.view(np.float64), rest[:half].view(_U64), rest[half:].view(np.float64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        slot, low = _slot(pairs, self.bits), min(self.bits, _SLICE_BITS)
        if len(self.slices) == 1 and 0 in self.slices and low == self.bits:
            return self._of(0, pairs, slot)
        out = np.empty(len(pairs))
        part = slot >> low
        order = np.argsort(part, kind="stable")
        for at in np.split(order, _runs(part[order])[1:]) if len(order) else []:
            out[at] = self._of(int(part[at[0]]), pairs[at], slot[at] & ((1 << low) - 1))
        return out

    def _of(self, part: int, pairs: np.ndarray, slot: np.ndarray) -> np.ndarray:
        keys, values, rest_keys, rest_values = self.slices[part]
        out = values[slot]
        other = np.flatnonzero(keys[slot] != pairs)
        if len(other):
            out[other] = rest_values[np.searchsorted(rest_keys, pairs[other])]
        return out


def _write_slices(folder: str, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def written() -> pa.RecordBatch:
            path = f"{folder}/{part}-{uuid.uuid4().hex}"
            fs, name = filesystem(path)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name, compression=None) as f:
                f.write(pack_slice(np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held]), bits))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path])], ["part", "path"])

        for b in batches:
            parts = b.column(3).to_numpy()
            for at in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1) if len(parts) else []:
                if part is not None and parts[at[0]] != part:
                    yield written()
                    held = []
                part = int(parts[at[0]])
                held.append((_pair(b.column(0).to_numpy().view(_U64)[at], b.column(1).to_numpy()[at]), b.column(2).to_numpy()[at]))
        if held:
            yield written()

    return run


#: The table a Python worker used last, by its folder; its next task finds it here.
_TABLES: dict[str, CostTable] = {}


def _table(folder: str, slices: dict[int, str], bits: int) -> CostTable:
    if folder not in _TABLES:
        _TABLES.clear()
        _TABLES[folder] = CostTable(slices, bits)
    return _TABLES[folder]


def _score(folder: str, slices: dict[int, str], bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(folder, slices, bits)
        for b in batches:
            for first, texts in _pieces(b.column(1)):
                row, code, k = _row_grams(texts)
                total = np.bincount(row, table(_pair(code, k)) * k, minlength=len(texts)) if len(row) else np.zeros(len(texts))
                null = ~np.array(b.column(1).slice(first, len(texts)).is_valid())
                sizes = pa.array(np.array([len(t) for t in texts], np.int64), mask=null)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), sizes, pa.array(total, mask=null)], ["doc_id", "n_bytes", "bits"])

    return run


def _grams_per_row(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in _pieces(b.column(1)):
            row, code, k = _row_grams(texts)
            ids = b.column(0).slice(first, len(texts)).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(code.view(np.int64)), pa.array(np.minimum(k, _MOST).astype(np.int32)), pa.array(k)], ["row", "code", "k", "times"])


def ctw_scores(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte of every row of docs(doc_id, text) under the model of all of them.

    Null text: null n_bytes, bits and bits_per_byte. Empty text: 0 bytes, 0 bits, null
    bits_per_byte. Repeated rows count, and are scored, each, so that each knows the other. A
    null doc_id stays null. Texts are counted and scored whole, a few MB of them at a time,
    whatever their length. Other columns are not read; an empty table gives none.

    Code lengths are looked up in a table of at most table_bytes; a larger model is joined by
    gram instead, with the same result.
    """
    grams = materialize(corpus_grams(docs))
    bits = table_bits(grams.count())
    costs = gram_costs(grams, bits)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    if 16 << bits <= table_bytes:
        folder = scratch_path(docs.sparkSession, "ctw")
        found = costs.repartition("part").sortWithinPartitions("part").mapInArrow(_write_slices(folder, bits), "part int, path string").collect()
        scored = rows.mapInArrow(_score(folder, {r.part: r.path for r in found}, bits), "doc_id bigint, n_bytes bigint, bits double")
    else:
        # a row's number is drawn once: the checkpoint keeps it from being drawn anew
        numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
        per_row = numbered.select("row", "text").mapInArrow(_grams_per_row, "row bigint, code bigint, k int, times bigint")
        sums = per_row.join(costs.drop("part"), ["code", "k"]).groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("bits"))
        scored = numbered.select("row", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")).join(sums, "row", "left")
        scored = scored.select("doc_id", "n_bytes", F.when(F.col("n_bytes").isNotNull(), F.coalesce("bits", F.lit(0.0))).alias("bits"))
    total = F.round("bits", 3)
    return scored.select("doc_id", "n_bytes", total.alias("bits"), F.when(F.col("n_bytes") > 0, F.round(total / F.col("n_bytes"), 6)).alias("bits_per_byte"))
