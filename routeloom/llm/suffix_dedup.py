"""Operator 7: removal of repeated 200-byte strings by a distributed merge sort of suffixes.

Every 200-byte window selects one anchor, its leftmost smallest-hash 64-byte gram; equal windows
select anchors at the same offset. So it is enough to sort the suffixes at anchors, and of those only
the ones whose gram occurs at least twice in the corpus:

1. Documents are dealt into blocks by hash; a block is the unit that is read, sorted and answered.
2. Blocks send their distinct anchor grams by hash to routes, which answer with the repeated ones.
3. A block sorts the suffixes (200 bytes) of its repeated anchors, collapses equal contexts, and sends
   one front-coded run to each route: common-prefix length with the predecessor and the rest, plus the
   bytes before the anchor.
4. A route merges its runs with a loser tree that keeps for each run the prefix length known to be
   shared with the last winner: unequal lengths decide without looking at the strings, equal ones are
   compared from that length on. The merge yields the sorted suffixes and all neighbour lengths.
5. A window at offset o before an anchor is repeated if another suffix shares 200 - o bytes (the same
   common-prefix interval) and the o bytes before it (the same group among sorted left contexts).
   The smallest and largest such o give the bytes to remove around the anchor.

The answer is exact. Matches never cross documents and are judged on the input.

Edge cases: null or empty text and texts under 200 bytes lose nothing. Repeated rows are rows: two
equal ones of 200 bytes or more lose everything. Overlapping repeats within a text count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import as_bytes, mix64, release, reliable, slices, spans_union

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
PAD = 255
PLACE_BITS = 32  # the same for every slice, so that equal windows choose equal anchors even where hashes tie


class Anchors:
    """Anchor positions and gram hashes of texts; powers are kept between calls."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))
            self.inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))))

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with padding between texts, start of each text, anchor positions there, their hashes)."""
        gap = bytes([PAD]) * self.length
        size = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(size + self.length) - size
        a = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        n, w, g = len(a), self.window, self.gram
        self._powers(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.power[:n])))
        h = mix64((total[g:] - total[:-g]) * self.inverse[: n - g + 1])
        bits = np.uint64(PLACE_BITS)
        top = (h >> bits) << bits | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(top) // w)
        grid = np.full(blocks * w, np.uint64(2**64 - 1))
        grid[: len(top)] = top
        grid = grid.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        low = np.minimum(back[: blocks * w - w + 1], ahead[w - 1:])
        long = size >= self.length
        first, count = start[long], size[long] - self.length + 1
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        pos = (low[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))] if len(pos) else pos
        return a, start, pos, h[pos]


def lcp_rows(a: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row of a byte matrix with the row before it (0 for the first)."""
    if not len(a):
        return np.zeros(0, np.int64)
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    diff = a[1:] != a[:-1]
    return np.concatenate(([0], np.where(diff.any(1), diff.argmax(1), a.shape[1])))


def sort_rows(*parts: np.ndarray) -> np.ndarray:
    """Order of rows of byte matrices, earlier parts first."""
    keys = []
    for p in parts:
        wide = np.zeros((len(p), -(-p.shape[1] // 8) * 8), np.uint8)
        wide[:, : p.shape[1]] = p
        keys += list(wide.view(">u8").T)
    return np.lexsort(keys[::-1]) if keys else np.arange(len(parts[0]))


def make_run(left: np.ndarray, right: np.ndarray, room: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> bytes:
    """Front-coded sorted run; equal contexts become one entry with several places."""
    order = sort_rows(right, left)
    left, right, room, rid, pos = left[order], right[order], room[order], rid[order], pos[order]
    lcp = lcp_rows(right)
    new = np.concatenate(([True], (lcp[1:] < right.shape[1]) | (left[1:] != left[:-1]).any(1)))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
    left, right, room, lcp = left[new], right[new], room[new], lcp[new]
    rest = np.arange(right.shape[1])[None, :] >= lcp[:, None]
    body = b"".join(x.tobytes() for x in (
        np.array([len(lcp), len(rid)], "<i8"), lcp.astype(np.uint8), size.astype("<i4"), room.astype(np.uint8),
        rid.astype("<i8"), pos.astype("<i4"), left, right[rest],
    ))
    return zstandard.ZstdCompressor(level=1).compress(body)


def read_run(blob: bytes, length: int, reach: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes, prefix lengths, sizes, room, row ids, positions, left contexts) of a run."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m, total = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    at = 16

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    lcp = take("u1", m).tolist()
    size, room = take("<i4", m), take("u1", 2 * m).reshape(m, 2)
    rid, pos = take("<i8", total), take("<i4", total)
    left = take("u1", m * reach).reshape(m, reach)
    text, before = [], b""
    for c in lcp:
        before = before[:c] + raw[at:at + length - c]
        at += length - c
        text.append(before)
    return text, lcp, size, room, rid, pos, left


def common(a: bytes, b: bytes, start: int) -> int:
    """Common-prefix length of two strings of one size that agree up to start."""
    if a == b:
        return len(a)
    x = int.from_bytes(a[start:]) ^ int.from_bytes(b[start:])
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over front-coded runs: (run, entry) in sorted order and neighbour prefix lengths.

    A contender is (run, entry, shared) where shared is its common-prefix length with the last
    winner. Of two, the one with the longer shared prefix is smaller; only ties are compared, from
    that length on, and the loser keeps the length it shares with the one that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    texts = [r[0] for r in runs]
    lcps = [r[1] for r in runs]
    entry, shared = [0] * k, [0] * k
    done = [i >= len(runs) or not texts[i] for i in range(k)]

    def beats(a: int, b: int) -> bool:
        """Whether a wins against b; settles the loser's shared length."""
        if done[a] or done[b]:
            return done[b] and not done[a]
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        s, t = texts[a][entry[a]], texts[b][entry[b]]
        c = common(s, t, shared[a])
        if c == len(s) or s[c] < t[c]:
            shared[b] = c
            return True
        shared[a] = c
        return False

    tree = [0] * k
    winners = list(range(k)) if k == 1 else None
    if k > 1:
        level = list(range(k))
        base = k
        while len(level) > 1:
            base //= 2
            up = []
            for i in range(0, len(level), 2):
                a, b = level[i], level[i + 1]
                win = beats(a, b)
                tree[base + i // 2] = b if win else a
                up.append(a if win else b)
            level = up
        best = level[0]
    else:
        best = winners[0]
    order, lengths = [], []
    while not done[best]:
        order.append((best, entry[best]))
        lengths.append(shared[best])
        entry[best] += 1
        if entry[best] == len(texts[best]):
            done[best] = True
        else:
            shared[best] = lcps[best][entry[best]]
        at = (best + k) // 2
        while at:
            other = tree[at]
            if not done[other] and beats(other, best):
                tree[at], best = best, other
            at //= 2
    return order, lengths


def repeated_offsets(lcp: np.ndarray, left: np.ndarray, room: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes: least and largest offset o at which the window is repeated (-1: none)."""
    m, reach = left.shape
    order = sort_rows(left)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    left_lcp = lcp_rows(left[order])
    least, most = np.full(m, -1), np.full(m, -1)
    for o in range(reach + 1):
        group = np.cumsum(lcp < length - o)
        size = np.bincount(group, weight)
        at = np.flatnonzero((size[group] > 1) & (room[:, 0] >= o) & (room[:, 1] >= length - o))
        if not len(at):
            continue
        side = np.cumsum(left_lcp < o)[place[at]] if o else np.zeros(len(at), np.int64)
        key = group[at] * np.int64(m + 2) + side
        by = np.argsort(key, kind="stable")
        s = key[by]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        total = np.add.reduceat(weight[at][by], first)
        hit = at[by[np.repeat(total > 1, np.diff(np.concatenate((first, [len(s)]))))]]
        most[hit] = o
        fresh = hit[least[hit] < 0]
        least[fresh] = o
    return least, most


def routes_of(h: np.ndarray, routes: int) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % routes


def dealt(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rid tells a block's documents apart; equal rows may share it, they lose the same bytes
    block, rid = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int"), F.xxhash64(text, F.col(id_col), F.lit(1))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), block.alias("block"), rid.alias("rid")), blocks


def grams(docs: DataFrame, blocks: int, routes: int, anchors: Anchors) -> DataFrame:
    """(block, route, run): distinct anchor grams of a block with 1 or 2 (twice or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            blocks, texts = np.array(b.column(0)), as_bytes(b.column(1))
            for block in np.unique(blocks).tolist():
                mine = [texts[i] for i in np.flatnonzero(blocks == block)]
                for lo, hi in slices(mine, SLICE_BYTES):
                    held.setdefault(block, []).append(anchors.find(mine[lo:hi])[3])
        for block, parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            route = routes_of(h, routes)
            order = np.argsort(route, kind="stable")
            at = np.searchsorted(route[order], np.arange(routes + 1))
            for r in range(routes):
                part = order[at[r]:at[r + 1]]
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([r], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([h[part].tobytes() + np.minimum(n[part], 2).astype(np.uint8).tobytes()], pa.binary())], names=["block", "route", "n", "run"])

    return docs.select("block", "text").repartition(blocks, "block").mapInArrow(run, "block int, route int, n bigint, run binary")


def repeated(runs: DataFrame) -> DataFrame:
    """(block, run): the grams of a block that occur twice or more in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for block, n, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                parts.append((block, np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint8, n, 8 * n)))
        if not parts:
            return
        h, back = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        twice = np.bincount(back, np.concatenate([p[2] for p in parts])) > 1
        at = 0
        for block, mine, _ in parts:
            hit = mine[twice[back[at:at + len(mine)]]]
            at += len(mine)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([hit.tobytes()], pa.binary())], names=["block", "run"])

    return runs.mapInArrow(run, "block int, run binary")


def block_texts(left: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return np.array(left.column("rid").combine_chunks()), as_bytes(left.column("text"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row."""
    anchors = Anchors(length, min(gram, length))
    reach = anchors.window - 1
    docs, blocks = dealt(df, id_col, text_col, block_bytes)
    routes = min(4096, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks))
    found = reliable(repeated(grams(docs, blocks, routes, anchors).repartition(routes, "route")))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"block": [], "route": [], "run": []}
        blobs = right.column("run").to_pylist()
        if blobs and len(left):
            rid, texts = block_texts(left)
            block = left.column("block")[0].as_py()
            known = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]))
            parts = []
            for lo, hi in slices(texts, SLICE_BYTES):
                a, start, pos, h = anchors.find(texts[lo:hi])
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                pos, h = pos[known[at] == h], h[known[at] == h]
                doc = np.searchsorted(start, pos, side="right") - 1
                size = np.array([len(t) for t in texts[lo:hi]], np.int64)
                inside = pos - start[doc]
                room = np.stack((np.minimum(inside, reach), np.minimum(size[doc] - inside, length)), 1)
                around = a[pos[:, None] + np.arange(-reach, length)[None, :]] if len(pos) else np.zeros((0, reach + length), np.uint8)
                parts.append((around[:, :reach][:, ::-1], around[:, reach:], room, rid[lo + doc], inside, h))
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
            route = routes_of(joined[5], routes)
            for r in np.unique(route).tolist():
                mine = route == r
                out["block"].append(block)
                out["route"].append(r)
                out["run"].append(make_run(*(x[mine] for x in joined[:5])))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "route": pa.array(out["route"], pa.int32()), "run": pa.array(out["run"], pa.binary())})

    runs = docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, "block int, route int, run binary")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_of, read = [], []
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                blocks_of.append(block)
                read.append(read_run(blob, length, reach))
        if not read:
            return
        order, lcp = merge([(r[0], r[1]) for r in read])
        base = np.cumsum([0, *[len(r[0]) for r in read]])
        flat = np.fromiter((base[i] + j for i, j in order), np.int64, len(order))
        size, room, left = (np.concatenate([r[x] for r in read]) for x in (2, 3, 6))
        least, most = repeated_offsets(np.array(lcp), left[flat], room[flat].astype(np.int64), size[flat].astype(np.int64), length)
        lo, hi = np.full(len(flat), -1), np.full(len(flat), -1)
        lo[flat], hi[flat] = least, most
        for k, block in enumerate(blocks_of):
            n = read[k][2]
            a, z = np.repeat(lo[base[k]:base[k + 1]], n), np.repeat(hi[base[k]:base[k + 1]], n)
            hit = a >= 0
            if hit.any():
                pos = read[k][5][hit].astype(np.int64)
                body = read[k][4][hit].tobytes() + (pos - z[hit]).astype("<i8").tobytes() + (pos + length - a[hit]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary())], names=["block", "run"])

    spans = reliable(runs.repartition(routes, "route").mapInArrow(settle, "block int, run binary"))
    kind = next(f.dataType for f in df.schema.fields if f.name == id_col)
    fields = [T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if with_text else []))

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        rid, texts = block_texts(left)
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8").reshape(3, -1) for b in right.column("run").to_pylist()]
        who, begin, end = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
        by = np.argsort(who, kind="stable")
        who, begin, end = who[by], begin[by], end[by]
        a, z = np.searchsorted(who, rid), np.searchsorted(who, rid, side="right")
        rows = [[], [], [], [], []]
        for t, lo, hi in zip(texts, a.tolist(), z.tolist(), strict=True):
            kept, removed, n = t, 0, 0
            if hi > lo:
                gone = spans_union(begin[lo:hi], end[lo:hi], len(t))
                removed = int(gone.sum())
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            for c, v in zip(rows, (len(t), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                c.append(v)
        cols = [left.column("id").cast(arrow.field(0).type), *[pa.chunked_array([pa.array(c, arrow.field(i + 1).type)]) for i, c in enumerate(rows[: len(arrow) - 1])]]
        return pa.Table.from_arrays(cols, schema=arrow)

    release(df.sparkSession)
    return docs.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(strip, schema)
