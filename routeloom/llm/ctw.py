"""Operator 4: language-model scoring by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions (a bit tree of 255 nodes); every decision has a
context tree over the preceding bytes, most recent first, to depth DEPTH. A node mixes its own
Krichevsky-Trofimov estimate with the product of its children, half and half, and the trained
tree's posterior weights give the prediction along a context path: the KT estimates of all depths
mixed. The score of a text is its log10 probability; ``bits_per_byte`` is its code length.

Texts are lower-cased (A-Z), start in a context of 0xFF bytes and end with 0xFF, which UTF-8 never
uses. Everything is counted over all training documents, and nothing corpus-sized is broadcast or
collected:

1. Documents are dealt into blocks of about BLOCK_BYTES. A block yields its distinct (context, byte)
   codes and distinct words with their training counts, as delta-coded runs, one a route.
2. Codes meet by their three most recent context bytes (TOP), words by hash. A route holds whole
   subtrees from that depth down, sums their weighted probabilities and hands the rest to the driver,
   which keeps the levels above: at most 2^24 bit nodes whatever the corpus, some 10^5 in practice.
3. With those known, each route computes the log probability of each of its codes once and sends the
   bare values back to the blocks that asked; a block derives its sorted codes from its texts again,
   so that no key travels twice, and scores its documents by table lookup.

Words meet by 64-bit hashes that are not checked: two of a corpus' W distinct words are expected to
be taken for one W^2 / 2^65 times (0.03 times at 10^9).

Edge cases: a null or empty text is only the end symbol (one token). Without training documents the
model is uniform: each bit costs one bit. Repeated rows are scored and counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import LOWER, as_bytes, crc_mod, release, reliable, slices

DEPTH = 5
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
TOP = 3  # levels above this depth are held by the driver
UNIT = 2.0**36  # log probabilities travel as multiples of 1 / UNIT
EDGE = 255
HALF = math.log(0.5)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for integers n >= 0."""
    return _stirling(n + 0.5)


def _stirling(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    small = x < 10
    y = x.copy()
    for _ in range(10):
        now = small & (y < 10)
        if not now.any():
            break
        shift[now] += np.log(y[now])
        y[now] += 1
    inv = 1 / y
    i2 = inv * inv
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a block of n0 zeros and n1 ones under the KT estimator."""
    return log_gamma_half(n0) + log_gamma_half(n1) - _stirling(n0 + n1 + 1.0) - math.log(math.pi)


def bit_nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context * 256 + byte, count) -> sorted (context * 256 + bit node, zeros, ones)."""
    ctx, byte = key >> 8, key & 255
    ids, zero, one = [], [], []
    for k in range(8):
        node = (ctx << 8) | ((1 << k) | (byte >> (8 - k)))
        bit = (byte >> (7 - k)) & 1
        # keys are sorted, so equal nodes of one level stand together
        start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ids.append(node[start])
        zero.append(np.add.reduceat(np.where(bit == 0, n, 0), start))
        one.append(np.add.reduceat(np.where(bit == 1, n, 0), start))
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.concatenate(zero)[order].astype(float), np.concatenate(one)[order].astype(float)


def fold(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys; sorted."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(start) else n


class Tree:
    """Levels of a context tree from ``top`` to ``depth``; codes hold c1..c_depth and the byte, c1 highest."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, top: int, depth: int = DEPTH):
        self.top, self.depth, self.level = top, depth, {}
        below = None
        for d in range(depth, top - 1, -1):
            key, count = (codes, n) if d == depth else fold(((codes >> (8 * (depth - d + 1))) << 8) | (codes & 255), n)
            if not len(key):
                self.level[d] = (key, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
                continue
            node, n0, n1 = bit_nodes(key, count)
            own = log_kt(n0, n1)
            total = own
            if below is not None:
                child, weight = below
                at = np.searchsorted(node, ((child >> 16) << 8) | (child & 255))
                total = np.logaddexp(HALF + own, HALF + np.bincount(at, weight, len(node)))
            self.level[d] = (node, n0, n1, own, total)
            below = (node, total)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the level above the top and the summed log weights of their children."""
        node, _, _, _, total = self.level[self.top]
        up = ((node >> 16) << 8) | (node & 255)
        keys, back = np.unique(up, return_inverse=True)
        return keys, np.bincount(back, total, len(keys))

    def mix(self, codes: np.ndarray, k: int, deeper: np.ndarray | None = None) -> np.ndarray:
        """Probability of bit k of each code's byte, from the deepest level up to the top."""
        byte = codes & 255
        one = (byte >> (7 - k)) & 1
        p = np.full(len(codes), 0.5) if deeper is None else deeper
        for d in range(self.depth, self.top - 1, -1):
            node, n0, n1, own, total = self.level[d]
            if not len(node):
                continue
            want = ((codes >> (8 * (self.depth - d + 1))) << 8) | ((1 << k) | (byte >> (8 - k)))
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            seen = node[at] == want
            kt = (np.where(one == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            w = np.ones(len(codes)) if d == self.depth and deeper is None else np.exp(np.minimum(0, HALF + own[at] - total[at]))
            p = np.where(seen, w * kt + (1 - w) * p, p if d < self.depth or deeper is not None else 0.5)
        return p


class Top:
    """Levels 0 to TOP - 1 from the histogram of the last of them and the summed log weights of the level below."""

    def __init__(self, hist: tuple[np.ndarray, np.ndarray], sums: tuple[np.ndarray, np.ndarray]):
        key, n = fold(*hist)
        self.levels = {}
        below = sums
        for d in range(TOP - 1, -1, -1):
            own_key, count = fold(((key >> (8 * (TOP - d))) << 8) | (key & 255), n) if d < TOP - 1 else (key, n)
            if not len(own_key):
                self.levels[d] = None
                continue
            node, n0, n1 = bit_nodes(own_key, count)
            own = log_kt(n0, n1)
            at = np.searchsorted(node, below[0])
            total = np.logaddexp(HALF + own, HALF + np.bincount(at, below[1], len(node)))
            self.levels[d] = (node, n0, n1, own, total)
            up = ((node >> 16) << 8) | (node & 255)
            keys, back = np.unique(up, return_inverse=True)
            below = (keys, np.bincount(back, total, len(keys)))

    def mix(self, codes: np.ndarray, k: int, p: np.ndarray, depth: int) -> np.ndarray:
        byte = codes & 255
        one = (byte >> (7 - k)) & 1
        for d in range(TOP - 1, -1, -1):
            if self.levels[d] is None:
                continue
            node, n0, n1, own, total = self.levels[d]
            want = ((codes >> (8 * (depth - d + 1))) << 8) | ((1 << k) | (byte >> (8 - k)))
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            seen = node[at] == want
            kt = (np.where(one == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            w = np.exp(np.minimum(0, HALF + own[at] - total[at]))
            p = np.where(seen, w * kt + (1 - w) * p, p)
        return p


def codes_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all positions (end symbol included) and the number of positions of each text."""
    pad = bytes([EDGE]) * depth
    size = np.array([len(t) + 1 for t in texts], np.int64)
    a = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8).astype(np.int64)
    n = len(a) - depth
    code = a[depth:].copy()
    for j in range(1, depth + 1):  # c_j sits above c_(j+1)
        code |= a[depth - j:depth - j + n] << (8 * (depth - j + 1))
    end = np.cumsum(size + depth)
    keep = np.ones(n, bool)  # positions inside the padding between texts are no predictions
    for j in range(depth):
        keep[end[:-1] - depth + j] = False
    return code[keep], size


def squeezed(*columns: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane (the high planes are nearly constant), compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def unsqueezed(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view("<i8").ravel() for c in np.split(raw, columns)]


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as deltas with their counts."""
    return squeezed(np.diff(keys, prepend=np.int64(0)), n)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = unsqueezed(blob, 2)
    return np.cumsum(step), n


class Lookup:
    """Open-addressed table from 64-bit keys to values; misses cannot happen for keys that were put in."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
        used = np.zeros(1 << bits, bool)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = ~used[s]
            first = np.full(len(self.keys), -1, np.int64) if len(todo) > 1 << 16 else None
            if first is None:
                _, pick = np.unique(s, return_index=True)
                win = np.zeros(len(todo), bool)
                win[pick] = True
            else:
                first[s[::-1]] = np.arange(len(todo))[::-1]
                win = first[s] == np.arange(len(todo))
            put = todo[win & free]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            used[slot[put]] = True
            todo = todo[~(win & free)]
            slot[todo] = (slot[todo] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        s = self.slot(keys)
        out = self.values[s]
        todo = np.flatnonzero(self.keys[s] != keys)
        while len(todo):
            s[todo] = (s[todo] + 1) & self.mask
            hit = self.keys[s[todo]] == keys[todo]
            out[todo[hit]] = self.values[s[todo[hit]]]
            todo = todo[~hit]
        return out


def word_key(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


def routed(route: np.ndarray, routes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of sorted keys by route, in order."""
    order = np.argsort(route, kind="stable")
    at = np.searchsorted(route[order], np.arange(routes + 1))
    for r in np.flatnonzero(np.diff(at)).tolist():
        yield r, order[at[r]:at[r + 1]]


def code_route(codes: np.ndarray, routes: int, depth: int) -> np.ndarray:
    return route_of(codes >> (8 * (depth - TOP + 1)), routes)


def counted_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each occurs."""
    code = np.sort(codes_of(texts, depth)[0])
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[start], np.diff(np.concatenate((start, [len(code)])))


def route_of(prefix: np.ndarray, routes: int) -> np.ndarray:
    return ((prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % routes


def block_runs(docs: DataFrame, routes: int, depth: int) -> DataFrame:
    """(block, route, kind, run): kind 0 codes, 1 words; counts are those of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(block: int) -> Iterator[pa.RecordBatch]:
            codes, words = held.pop(block)
            keys, n = fold(np.concatenate([c for c, _ in codes]), np.concatenate([m for _, m in codes]))
            rows = [(block, r, 0, packed(keys[i], n[i])) for r, i in routed(code_route(keys, routes, depth), routes)]
            wk = np.fromiter((word_key(w) for w in words), np.int64, len(words))
            keys, n = fold(wk, np.fromiter(words.values(), np.int64, len(words)))
            rows += [(block, r, 1, packed(keys[i], n[i])) for r, i in routed(route_of(keys, routes), routes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "route", "kind", "run"]) if rows else pa.RecordBatch.from_pylist([])

        for b in batches:
            blocks, train, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))
            for lo, hi in slices(texts, SLICE_BYTES):
                lower = [t.translate(LOWER) for t in texts[lo:hi]]
                for block in set(blocks[lo:hi]):
                    for value in (False, True):
                        at = [i for i in range(hi - lo) if blocks[lo + i] == block and train[lo + i] == value]
                        if not at:
                            continue
                        part = [lower[i] for i in at]
                        code, n = counted_codes(part, depth)
                        codes, words = held.setdefault(block, ([], {}))
                        codes.append((code, n * value))
                        if len(codes) > 24:
                            codes[:] = [fold(np.concatenate([c for c, _ in codes]), np.concatenate([m for _, m in codes]))]
                        for t in part:
                            for w in t.split():
                                words[w] = words.get(w, 0) + value
            if len(held) > 1:  # rows of a block stand together: earlier blocks are complete
                for block in [x for x in held if x != blocks[-1]]:
                    yield from out(block)
        for block in list(held):
            yield from out(block)

    return docs.select("block", "train", "text").mapInArrow(run, "block int, route int, kind int, run binary")


def gather(batches: Iterator[pa.RecordBatch]) -> tuple[dict, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The runs of a partition by (block, route, kind), and the summed codes and words."""
    runs, parts = {}, {0: [], 1: []}
    for b in batches:
        for block, route, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            keys, n = unpacked(blob)
            runs.setdefault((block, route, kind), []).append(keys)
            parts[kind].append((keys, n))
    total = {}
    for kind, p in parts.items():
        keys, n = fold(np.concatenate([k for k, _ in p]), np.concatenate([c for _, c in p])) if p else (np.zeros(0, np.int64),) * 2
        total[kind] = keys[n > 0], n[n > 0]
    return runs, total[0], total[1]


def tops(runs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, value): 0 histogram of level TOP - 1, 1 summed log weights of nodes at TOP, 2 distinct words, 3 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, (codes, n), (_, count) = gather(batches)
        rows = [(2, 0, float(len(count))), (3, 0, float(count.sum()))]
        if len(codes):
            keys, sums = Tree(codes, n, TOP, depth).sums()
            rows += [(1, k, v) for k, v in zip(keys.tolist(), sums.tolist(), strict=True)]
            keys, sums = fold(((codes >> (8 * (depth - TOP + 2))) << 8) | (codes & 255), n)
            rows += [(0, k, float(v)) for k, v in zip(keys.tolist(), sums.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["kind", "key", "value"])

    return runs.mapInArrow(run, "kind int, key bigint, value double").groupBy("kind", "key").agg(F.sum("value").alias("value"))


def answers(runs: DataFrame, depth: int, shared_top) -> DataFrame:
    """(block, kind, route, run) for every run: log10 probabilities of its codes, counts of its words, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (codes, n), (words, count) = gather(batches)
        tree, top = Tree(codes, n, TOP, depth), shared_top.value
        for kind in (0, 1):
            mine = [(k, keys) for k, v in asked.items() if k[2] == kind for keys in v]
            if not mine:
                continue
            every = np.unique(np.concatenate([keys for _, keys in mine]))
            value = np.zeros(len(every))
            if kind == 0:
                for lo in range(0, len(every), 1 << 18):
                    part = every[lo:lo + (1 << 18)]
                    for k in range(8):
                        p = top.mix(part, k, tree.mix(part, k), depth)
                        value[lo:lo + (1 << 18)] += np.log10(p)
            elif len(words):
                at = np.minimum(np.searchsorted(words, every), len(words) - 1)
                value = np.where(words[at] == every, count[at], 0).astype(float)
            value = np.rint(value * UNIT) if kind == 0 else value
            for (block, route, _), keys in mine:
                blob = squeezed(value[np.searchsorted(every, keys)])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (block, kind, route)] + [pa.array([blob], pa.binary())], names=["block", "kind", "route", "run"])

    return runs.mapInArrow(run, "block int, kind int, route int, run binary")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Held-out flag, token counts, unigram base score, log10 probability and code length for every row."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    routes = min(4096, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(
        F.col(id_col).alias("id"), text.alias("text"), (crc_mod(id_col, 5) != 1).alias("train"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"),
    )
    dealt = docs.repartition(max(blocks, 1), "block").sortWithinPartitions("block")
    runs = reliable(block_runs(dealt, routes, depth))
    by_route = runs.select("block", "route", "kind", "run").repartition(routes, "route")
    head = {k: [] for k in range(4)}
    for kind, key, value in zip(*(c.to_pylist() for c in tops(by_route, depth).toArrow().columns), strict=True):
        head[kind].append((key, value))
    table = {k: (np.array([x for x, _ in sorted(v)], np.int64), np.array([y for _, y in sorted(v)])) for k, v in head.items()}
    top = Top(table[0], table[1])
    n_train = docs.where("train").count()
    n_words = int(sum(v for _, v in head[3])) + n_train
    distinct = int(sum(v for _, v in head[2])) + (n_train > 0)
    log_total = math.log10(n_words + 0.5 * (distinct + 1))
    end_term = math.log10(n_train + 0.5) - log_total
    release(spark)
    replies = answers(by_route, depth, spark.sparkContext.broadcast(top))
    kind = next(f.dataType for f in df.schema.fields if f.name == id_col)
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()),
    ])

    def one_block(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        texts = [t.translate(LOWER) for t in as_bytes(left.column("text"))]
        replied = dict(zip(zip(right.column("kind").to_pylist(), right.column("route").to_pylist(), strict=True), right.column("run").to_pylist(), strict=True))

        def table_of(kind: int, keys: np.ndarray, route: np.ndarray) -> Lookup:
            value = np.zeros(len(keys))
            for r, i in routed(route, routes):
                value[i] = unsqueezed(replied[kind, r], 1)[0]
            return Lookup(keys, value / UNIT if kind == 0 else value)

        codes, words = [], set()
        for lo, hi in slices(texts, SLICE_BYTES):
            codes.append(counted_codes(texts[lo:hi], depth))
            words.update(*(t.split() for t in texts[lo:hi]))
            if len(codes) > 24:
                codes[:] = [fold(*(np.concatenate(x) for x in zip(*codes, strict=True)))]
        keys = fold(*(np.concatenate(x) for x in zip(*codes, strict=True)))[0]
        log_p = table_of(0, keys, code_route(keys, routes, depth))
        keys = np.unique(np.fromiter(map(word_key, words), np.int64, len(words)))
        count = table_of(1, keys, route_of(keys, routes))
        del codes, words, keys
        tokens, known, base, total = (np.zeros(len(texts)) for _ in range(4))
        for lo, hi in slices(texts, SLICE_BYTES):
            part = texts[lo:hi]
            code, n = codes_of(part, depth)
            total[lo:hi] = np.bincount(np.repeat(np.arange(len(part)), n), log_p.get(code), len(part))
            split = [t.split() for t in part]
            n = np.array([len(s) for s in split])
            names = {w: 0 for s in split for w in s}
            c = np.zeros(0)
            if names:
                value = count.get(np.fromiter((word_key(w) for w in names), np.int64, len(names)))
                table = dict(zip(names, value.tolist(), strict=True))
                c = np.fromiter((table[w] for s in split for w in s), float, int(n.sum()))
            doc = np.repeat(np.arange(len(part)), n)
            tokens[lo:hi] = n + 1
            known[lo:hi] = np.bincount(doc, c > 0, len(part)) + (n_train > 0)
            base[lo:hi] = np.bincount(doc, np.log10(c + 0.5) - log_total, len(part)) + end_term
        bits = -total * math.log2(10) / np.array([len(t) + 1 for t in texts])
        columns = [
            left.column("id"), [not x for x in left.column("train").to_pylist()], tokens.astype(np.int64), known.astype(np.int64),
            np.full(len(texts), n_words, np.int64), base, total, bits,
        ]
        return pa.Table.from_arrays([pa.chunked_array([pa.array(c, arrow.field(i).type)]) if i else c.cast(arrow.field(0).type) for i, c in enumerate(columns)], schema=arrow)

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(one_block, schema)
