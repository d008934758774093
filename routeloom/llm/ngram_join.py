"""Operator 6: n-gram Jaccard self-join by adaptive multi-match prefixes.

A document's set holds 64-bit hashes of its distinct 4-word shingles. Documents with equal sets
collapse into one node at once (a group of exact copies costs one node). Tokens follow one global
order, rare first, given by a fixed-size frequency sketch (2^20 counters, summed over all
documents); any fixed order keeps the filter exact, the sketch only makes it selective.

For a threshold of 85/100 a partner of a set of n tokens shares at least ceil(0.85 n) of them. With
the prefix of n - ceil(0.85 n) + l first tokens, two linked sets share at least l prefix tokens.
Each document picks its own l from 1 to 8: longer prefixes cost more postings but let fewer
candidates through, and l is the one of least estimated cost. A pair must share as many prefix
tokens as the smaller of its two l. Survivors are verified on their whole sets.

Groups of near copies are settled without their pairs: first every node is verified against the few
leaders, drawn from each token's nodes, with which it shares most prefix tokens, and components are
formed. Then all pairs of *different* components meet at their shared prefix tokens; for a pair's
sizes both prefixes are cut to what that pair's least overlap needs, the matches of each pair are
counted, and every pair with enough of them is verified, so no link between different components is
lost. A crowded token compares its components as wholes first, so the work of a group of near copies
does not grow with its square. Leaders are partial aggregates; joins on tokens are ordinary
equi-joins that spill and that adaptive execution can split.

Edge cases: null or empty text and text without words has an empty set, 0 shingles and itself as
component. Fewer than four words make one token. Repeated rows are each returned. A row without an
id takes part in links but never names a component, unless no member has an id (then null). A set is
named by 64 bits of its digest; sets whose names clash are found and named by 64 others.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.common import LOWER, Scratch, as_bytes, crc_mod, mix64, release, reliable, slices
from routeloom.llm.components import components

BUCKETS = 1 << 20
CHUNK = 1 << 12  # counters of the sketch that travel together
BITMAP = 1 << 24
DRAWS = 2  # leaders of a token by shared tokens, and as many by hash
TRIED = 2  # leaders that a node is verified with in a round
ROUNDS = 2  # of drawing leaders, before the exact step
CROWD = 64  # nodes of a token from which its components are compared first
WORDS = 200_000  # distinct words a worker remembers
MAX_MATCHES = 8
VERIFY_COST = 100.0  # of a candidate, in postings
UNSEEN = 0.15  # other holders of a token that the sketch takes for unique, on average
SLICE_BYTES = 2 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingle hashes of documents; word hashes are cached within a bound."""

    def __init__(self, width: int = 4):
        self.width = width
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [t.translate(LOWER).split() for t in texts]
        flat = [w for s in split for w in s]
        if len(self.number) > WORDS:
            self._forget()
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        new = islice(self.number, len(self.hashes), None)
        self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(self.number) - len(self.hashes))))
        h = self.hashes[ids]
        k, out, at = self.width, [], 0
        full = np.zeros(0, np.uint64)
        if len(h) >= k:
            full = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                full = full * PRIME + h[j:len(h) - k + 1 + j]
            full = mix64(full)
        for s in split:
            n = len(s)
            if n >= k:
                out.append(np.unique(full[at:at + n - k + 1]))
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for v in h[at:at + n]:
                        x = x * PRIME + v
                out.append(mix64(np.array([x ^ np.uint64(0x5BD1E995)], np.uint64)))
            else:
                out.append(full[:0])
            at += n
        return out


def names_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set; together they tell sets apart."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def node_of(tokens: np.ndarray, clashes: frozenset[int]) -> int:
    """The first name of a set, or its second where different sets have the same first."""
    first, second = names_of(tokens)
    return second if first in clashes else first


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def overlap_needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def pair_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of two linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(tokens: np.ndarray, level: np.ndarray, freq: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set and its number of required matches.

    The cost of l counts the postings of the prefix against a partner of equal size, the common case.
    """
    n = len(tokens)
    b = bucket_of(tokens)
    order = np.argsort((level[b].astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
    need = overlap_needed(n, percent)
    most = min(MAX_MATCHES, need)
    short = n - pair_overlap(n, n, percent)
    lists = np.cumsum(freq[b[order[: short + most]]])
    l = np.arange(1, most + 1)
    reach = lists[short + l - 1]
    cost = reach + VERIFY_COST * (reach - (short + l)) / l
    best = int(cost.argmin()) + 1
    return tokens[order[: n - need + best]], best


def survey(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """kind 0: (id, size, both names) of each row; kind 1: (chunk, counters) of the frequency sketch of a task."""
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "node", "other", "chunk", "counters"]
        sketch, make = np.zeros(BUCKETS, np.int64), Shingler(width)
        id_type = None
        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            id_type = ids.type
            for lo, hi in slices(texts, SLICE_BYTES):
                sets = make.sets(texts[lo:hi])
                if sets:
                    sketch += np.bincount(bucket_of(np.concatenate(sets)), minlength=BUCKETS)
                node, other = zip(*[names_of(s) if len(s) else (None, None) for s in sets], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), ids[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names)
        if id_type is not None:
            blobs = [zstandard.ZstdCompressor(level=1).compress(c.astype("<i8").tobytes()) for c in sketch.reshape(-1, CHUNK)]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3, pa.array(np.arange(n, dtype=np.int32)), pa.array(blobs, pa.binary())], names=names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"kind int, id {kind}, n bigint, node bigint, other bigint, chunk int, counters binary")


def sketch_of(seen: DataFrame) -> np.ndarray:
    """The summed frequency sketch: its size is fixed, each chunk of it is added up by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype("<i4").tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counters"])

    out = np.zeros(BUCKETS, np.int64)
    for r in seen.where("kind = 1").select("chunk", "counters").repartition("chunk").mapInArrow(run, "chunk int, counters binary").collect():
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counters"], "<i4")
    return out


def postings(df: DataFrame, text_col: str, width: int, percent: int, level: np.ndarray, freq: np.ndarray, clashes: frozenset[int]) -> DataFrame:
    """(token, node, place) for the chosen prefix of each node, once a node and task; place packs (n, l, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(width), set()
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in slices(texts, SLICE_BYTES):
                tok, nodes, rows = [], [], []
                for s in make.sets(texts[lo:hi]):
                    node = node_of(s, clashes) if len(s) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    p, l = prefix(s, level, freq, percent)
                    tok.append(p)
                    nodes.append(node)
                    rows.append((len(s), l, len(p)))
                if rows:
                    n, l, m = np.array(rows, np.int64).T
                    pos = np.concatenate([np.arange(x) for x in m])
                    place = np.repeat((n << 33) | (l << 29), m) | pos
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), m)), pa.array(place)], names=["token", "node", "place"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "token bigint, node bigint, place bigint")


def wanted_sets(df: DataFrame, id_col: str, text_col: str, width: int, rows: DataFrame, pairs: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """(node, tokens) of the nodes in pairs.

    One row of each node is needed; a fixed-size bitmap over their ids lets tasks skip most others.
    """
    nodes = reliable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    ids = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    spot = crc_mod("id", BITMAP)
    words = ids.select(F.floor(spot / 32).cast("int").alias("w"), (spot % 32).cast("int").alias("at")).selectExpr("w", "shiftleft(1L, at) bit").groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(BITMAP // 32, np.uint32)
    got = words.toPandas()
    table[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, bits = Shingler(width), set(), shared.value
        for b in batches:
            spots = b.column(0).to_numpy()
            hit = bits[spots >> 5] >> (spots & 31).astype(np.uint32) & np.uint32(1)
            texts = as_bytes(b.column(1).filter(pa.array(hit.astype(bool))))
            for lo, hi in slices(texts, SLICE_BYTES):
                keep, sets = [], []
                for s in make.sets(texts[lo:hi]):
                    node = node_of(s, clashes) if len(s) else None
                    if node is not None and node not in seen:
                        seen.add(node)
                        keep.append(node)
                        sets.append(s.view(np.int64))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    # the marked numbers are Spark's on both sides, whatever the id's type
    sets = df.select(crc_mod(id_col, BITMAP).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "node bigint, tokens array<bigint>")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    found = pairs.join(x, "a").join(y, "b")
    return found.where(both * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def leader_pairs(left: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): each node with the drawn leaders of other components that share most of its prefix tokens.

    left: token, node, n, l, shared, root. Each token draws some of its nodes by hashes of this round,
    and some among those of most shared prefix tokens: what a group was copied from shares all of its
    tokens, an edited copy has some of its own. The draws are partial aggregates. Only a good part of
    the prefix counts: this step is a shortcut.
    """
    mark = [F.xxhash64("node", F.lit(2 * DRAWS * k + j)) for j in range(2 * DRAWS)]
    order = [F.struct(F.when(F.lit(j < DRAWS), -F.col("shared")).otherwise(0), m) for j, m in enumerate(mark)]
    drawn = [F.min_by(F.struct("node", "root"), o).alias(f"d{j}") for j, o in enumerate(order)]
    table = left.groupBy("token").agg(*drawn).select("token", F.array_distinct(F.array(*[f"d{j}" for j in range(2 * DRAWS)])).alias("drawn"))
    star = left.join(table, "token").select("node", "n", "l", "root", F.explode("drawn").alias("d")).where("root <> d.root")
    star = star.groupBy("node", F.col("d.node").alias("leader")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("l").alias("l"))
    star = star.where(f"c >= l and 4 * c >= n - ({percent} * n + 99) div 100 + l")
    best = Window.partitionBy("node").orderBy(F.col("c").desc(), "leader")
    star = star.withColumn("r", F.row_number().over(best)).where(F.col("r") <= TRIED)
    return star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def multi_match(left: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share enough prefix tokens; loses no link.

    For a pair's sizes both prefixes are cut to what its own least overlap leaves, plus its l (the
    smaller of the two), and at least l tokens must stand in both. Tokens of few nodes are joined
    with themselves. Where a token has many nodes, its components are compared first, by bounds on
    their sizes and positions, so that no component is joined with itself, however large it is.
    """
    sizes = left.groupBy("token").agg(F.count("*").alias("m"))
    few = left.join(sizes.where(F.col("m") <= CROWD), "token")
    many = left.join(sizes.where(F.col("m") > CROWD), "token")
    need = f"({percent} * (cast(p.n as bigint) + q.n) + {99 + percent}) div {100 + percent}"
    fits = F.expr(f"p.n * 100L >= q.n * {percent} and q.n * 100L >= p.n * {percent} and {need} < least(p.n - p.pos, q.n - q.pos) + least(p.l, q.l)")
    pair = [F.col("p.node").alias("x"), F.col("q.node").alias("y"), F.least("p.l", "q.l").alias("l")]
    rows = few.alias("p").join(few.alias("q"), F.expr("p.token = q.token and p.root < q.root") & fits).select(*pair)

    group = many.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.expr("n - pos")).alias("rest"), F.max("l").alias("l"))
    bound = f"({percent} * (cast(p.low as bigint) + q.low) + {99 + percent}) div {100 + percent}"
    may = F.expr(f"p.high * 100L >= q.low * {percent} and q.high * 100L >= p.low * {percent} and {bound} < least(p.rest, q.rest) + least(p.l, q.l)")
    meet = group.alias("p").join(group.alias("q"), F.expr("p.token = q.token and p.root < q.root") & may)
    meet = meet.select("p.token", F.col("p.root").alias("r"), F.col("q.root").alias("s"), *[F.col(f"q.{c}") for c in ("low", "high", "rest", "l")])
    ends = many.select("token", "root", "node", "n", "l", "pos", F.col("n").alias("low"), F.col("n").alias("high"), F.expr("n - pos").alias("rest"))
    one = ends.alias("p").join(meet.alias("q"), F.expr("p.token = q.token and p.root = q.r") & may).select("p.*", "q.s")
    rows = rows.union(one.alias("p").join(ends.alias("q"), F.expr("p.token = q.token and p.s = q.root") & fits).select(*pair))
    counted = rows.groupBy("x", "y").agg(F.count("*").alias("c"), F.first("l").alias("l")).where("c >= l")
    return counted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    scratch = Scratch(df.sparkSession)
    seen = scratch.save("seen", survey(df, id_col, text_col, width))
    first = seen.where("kind = 0").groupBy("node").agg(F.min("other").alias("o1"), F.max("other").alias("o2"))
    # about (nodes squared) / 2^65 of them: none in practice, three at 10^10 different documents
    clashes = frozenset(r["node"] for r in first.where("o1 < o2").select("node").collect())
    name = F.when(F.col("node").isin(*clashes), F.col("other")).otherwise(F.col("node")) if clashes else F.col("node")
    rows = reliable(seen.where("kind = 0").select("id", "n", name.alias("node")))
    sketch = sketch_of(seen)
    scratch.drop("seen")
    floor = float(np.median(sketch))
    level = np.floor(np.log2(1 + sketch)).astype(np.int8)
    freq = np.maximum(1.0 + UNSEEN, sketch - 2 * floor)

    posts = scratch.save("posts", postings(df, text_col, width, percent, level, freq, clashes)).repartition("token")
    # the same columns in both branches, so that they read one exchange
    common = posts.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.min("place").alias("any"))
    common = common.where("low < top and any is not null").select("token")
    met = posts.join(common, "token").dropDuplicates(["token", "node"])
    apart = ["cast(shiftright(place, 33) as int) n", "cast(shiftright(place, 29) & 15 as int) l", f"cast(place & {(1 << 29) - 1} as int) pos"]
    shared = met.withColumn("shared", F.count("*").over(Window.partitionBy("node"))).selectExpr("token", "node", "shared", *apart)
    shared = scratch.save("shared", shared)
    scratch.drop("posts")
    edges, sets, root = None, None, None
    left = shared.withColumn("root", F.col("node"))
    for k in range(ROUNDS):
        star = reliable(leader_pairs(left, percent, k))
        if sets is None:
            sets = scratch.save("sets", wanted_sets(df, id_col, text_col, width, rows, star, clashes))
        # later rounds only use sets at hand: what they leave out the exact step below finds
        new = reliable(verified(star, sets, percent))
        if root is not None and not more_than_none(new):
            break
        edges = new if edges is None else reliable(edges.unionByName(new))
        root = components(edges)
        marked = shared.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = marked.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
        left = scratch.save(f"left{k}", marked.join(mixed, "token"))
        if k:
            scratch.drop(f"left{k - 1}")
    scratch.drop("sets")
    pairs = reliable(multi_match(left, percent))
    for name in ("shared", *[f"left{k}" for k in range(ROUNDS)]):
        scratch.drop(name)
    if more_than_none(pairs):
        edges = reliable(edges.unionByName(verified(pairs, wanted_sets(df, id_col, text_col, width, rows, pairs, clashes), percent)))
        root = components(edges)
    release(df.sparkSession)
    # the smallest id of a component, over all rows of all its nodes
    named = rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("node is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def more_than_none(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of the smallest id of each component, with all columns.

    Of rows with equal id and text one stays, that of the least hash over all columns. Rows without
    an id cannot be named and stay.
    """
    found = link(df, id_col, text_col, width, percent)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    stay = df.join(keep, df[id_col] == F.col("__keep"), "left_semi")
    if stay.groupBy(id_col).count().where("count > 1").limit(1).count():
        one = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.xxhash64(*df.columns)).alias("row")
        stay = stay.groupBy(id_col, text_col).agg(one).select("row.*")
    return stay.unionByName(df.where(F.col(id_col).isNull()))
