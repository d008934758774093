"""Trie of conversation prefixes, its subtree figures by heavy-path decomposition.

1. *Positions.* Turns are sorted by conversation and turn over all tasks and numbered along the sort.
2. *Nodes.* A prefix is named by its depth and 128 bits: the exclusive or, along the conversation, of
   hashes of (turn, position). A group-by over (conversation, depth) rows gives each node's members.
   From then on a node is (conv_id, depth): its smallest member and its depth, which are unique.
3. *Heavy paths.* The child with most members (ties: largest name) is its parent's heavy child. A light
   child has at most half of its parent's members, so that at most log2(conversations) light edges
   lie above any node. Each node learns its path's top by pointer doubling along heavy edges, nodes
   that have arrived drop out: one to one joins, log2(longest path) rounds.
4. *Light paths.* A path's total is handed to the node that its top hangs from, and so to that node's
   path, in log2(conversations) rounds over the table of paths.
5. *Suffix sums.* One running sum along each path, bottom to top, over a node's own values and those
   of the light paths below it.

Nothing meets by conversation, node or path in one task: running sums are cut over tasks
(``ordered``), counts are aggregated before they are exchanged, the joins whose probe side may be
crowded (many children of one node) are sort-merge joins that adaptive execution splits. A digest
of members has to see them in order: they are joined in chunks of CHUNK by a sort over all tasks,
and only the chunks of a node meet.

``rebuild`` makes the contract's conversations: the first h turns of another one, then the own ones.

Edge cases: a null role or text is empty; a null turn comes first; turns with one number stand by
role, then text; repeated rows are turns of their own; rows with a null conv_id belong to no
conversation and make no node; an empty table gives no rows, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch, reliable
from routeloom.llm.ordered import running

CHUNK = 2048
NODE = ["depth", "a", "b"]
NO_MEMBER = hashlib.sha256().hexdigest()


def positions(df: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), ta, tb (the turn's hash), chars (code points of its text)."""
    turns = df.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.select(
        "*", F.xxhash64("role", "text").alias("ta"), F.xxhash64(F.lit(7), F.length("role"), "text", "role").alias("tb"),
        F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("pos"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running(turns, ["conv_id"], order, ["pos"], scratch, "positions", keep=["ta", "tb", "chars"])


def rebuild(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c: the first h turns of c - c % group, then its own after its first h; h = crc32(c) % most.

    Conversations left without a turn have one row at position 0.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "ta", "tb", "chars")).alias("heads"))
    one = turns.where("pos = 1").select("conv_id", base.alias("base"), head.alias("h")).join(heads, "base", "left")
    lent = one.select("conv_id", F.filter("heads", lambda x: x["pos"] <= F.col("h")).alias("lent"))
    first = lent.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.pos", "t.ta", "t.tb", "t.chars")
    lent = lent.select("conv_id", F.when(F.col("lent").isNull(), 0).otherwise(F.size("lent")).cast("long").alias("n_lent"))
    own = turns.withColumn("h", head).where("pos > h or pos = 1").join(lent, "conv_id")
    own = own.select("conv_id", F.when(F.col("pos") > F.col("h"), F.col("pos") - F.col("h") + F.col("n_lent")).otherwise(0).cast("long").alias("pos"), "ta", "tb", "chars")
    return first.unionByName(own)


def digests(members: DataFrame, key: list[str], scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """key and conv_id rows -> key, ends_sha256: digest of the ids in ascending order, comma-joined."""
    n = len(key)
    kinds = dict(members.dtypes)
    keys_sql = ", ".join(f"{c} {kinds[c]}" for c in key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = [*[pa.int64()] * n, pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*key, "first_id", "ids"])
            rows.clear()
            return out

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n + 1)]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:n]], axis=0)
            cuts = np.flatnonzero(new)
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                k = tuple(int(c[lo]) for c in cols[:n])
                if k != now:
                    if ids:
                        rows.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = k, []
                ids += cols[n][lo:hi].tolist()
                while len(ids) >= chunk:
                    rows.append((*now, ids[0], ",".join(map(str, ids[:chunk]))))
                    ids = ids[chunk:]
            if len(rows) >= 1024:
                yield batch()
        if ids:
            rows.append((*now, ids[0], ",".join(map(str, ids))))
        if rows:
            yield batch()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            rows = []
            for *k, ids in zip(*(b.column(i).to_pylist() for i in (*range(n), n + 1)), strict=True):
                if k != now:
                    if sha is not None:
                        rows.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[*key, "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=[*key, "ends_sha256"])

    chunks = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(join, f"{keys_sql}, first_id long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first_id").mapInArrow(digest, f"{keys_sql}, ends_sha256 string")


def path_tops(nodes: DataFrame) -> DataFrame:
    """conv_id, depth and the top of the node's heavy path: top_conv, top_depth."""
    heavy, to = F.col("heavy"), ["to_conv", "to_depth"]
    point = nodes.select("conv_id", "depth", F.when(heavy, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("to_conv"), F.when(heavy, F.col("depth") - 1).otherwise(F.col("depth")).alias("to_depth"), (~heavy).alias("arrived"))
    point = reliable(point)
    done, active = point.where("arrived"), point.where("not arrived")
    while active.limit(1).count():
        # where the pointed-to node has arrived, its pointer is the top; else both together leap twice as far
        ahead = done.unionByName(active).toDF(*to, "next_conv", "next_depth", "stop")
        step = reliable(active.join(ahead, to).select("conv_id", "depth", F.col("next_conv").alias("to_conv"), F.col("next_depth").alias("to_depth"), F.col("stop").alias("arrived")))
        done, active = done.unionByName(step.where("arrived")), step.where("not arrived")
    return done.select("conv_id", "depth", F.col("to_conv").alias("top_conv"), F.col("to_depth").alias("top_depth"))


def prefix_trie(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the trie of (conv_id, pos, ta, tb, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    pos counts from 1; a row at position 0 states a conversation without turns.
    """
    rows = turns.where("pos > 0").select("conv_id", "pos", "chars", F.xxhash64("ta", "tb", "pos").alias("a"), F.xxhash64(F.lit(11), "tb", "pos", "ta").alias("b"), F.xxhash64("ta", "tb", "pos").alias("own_a"), F.xxhash64(F.lit(11), "tb", "pos", "ta").alias("own_b"))
    rows = running(rows, ["conv_id"], [F.col("pos")], ["a", "b"], scratch, "prefixes", xor=True, keep=["pos", "chars", "own_a", "own_b"])
    rows = rows.select("conv_id", F.col("pos").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "chars")
    # a node and the root, whose name is 0: every conversation is its member
    zero = F.lit(0).cast("long")
    below = rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    every = turns.select("conv_id").groupBy("conv_id").agg(F.lit(1).alias("one"))
    root = every.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("chars"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"))
    nodes = scratch.save("nodes", below.unionByName(root))
    family = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"), F.max(F.struct("n_convs", "a", "b")).alias("best"))
    nodes = nodes.join(family, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("best.a").alias("best_a"), F.col("best.b").alias("best_b"))
    placed = nodes.drop("best").hint("merge").join(parents, ["depth", "up_a", "up_b"], "left")
    placed = placed.select("conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", F.coalesce((F.col("a") == F.col("best_a")) & (F.col("b") == F.col("best_b")), F.lit(False)).alias("heavy"),
                           (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    placed = scratch.save("placed", placed)

    tops = path_tops(placed)
    nodes = scratch.save("paths", placed.join(tops, ["conv_id", "depth"]))
    TOP = ["top_conv", "top_depth"]
    # paths and the path that each hangs from, with what it hangs from
    path = nodes.groupBy(*TOP).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    hung = nodes.where("not heavy and depth > 0").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"), F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    edges = hung.hint("merge").join(tops.toDF("conv_id", "depth", "to_conv", "to_depth"), ["conv_id", "depth"])
    edges = reliable(edges.select(*TOP, F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"), "to_conv", "to_depth"))
    light, moved = [], reliable(path)
    while True:
        sent = reliable(moved.join(edges, TOP))
        if not sent.limit(1).count():
            break
        light.append(sent.groupBy(F.col("at_conv").alias("conv_id"), F.col("at_depth").alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved")))
        moved = sent.groupBy(F.col("to_conv").alias("top_conv"), F.col("to_depth").alias("top_depth")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    own = nodes.select(*TOP, "conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "leaf", "saved")
    if light:
        more = light[0]
        for x in light[1:]:
            more = more.unionByName(x)
        more = more.groupBy("conv_id", "depth").agg(F.sum("more_leaf").alias("more_leaf"), F.sum("more_saved").alias("more_saved"))
        own = own.join(more, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaf", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero)})
    own = own.select(*TOP, (-F.col("depth")).alias("up"), "conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "leaf", "saved")
    summed = running(own, TOP, [F.col("up")], ["leaf", "saved"], scratch, "suffixes", keep=["conv_id", *NODE, "parent_conv_id", "n_convs", "n_children"])

    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    idle = every.join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    ends = digests(last.unionByName(idle), NODE, scratch)
    return summed.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"))


__all__ = ["positions", "prefix_trie", "rebuild"]
