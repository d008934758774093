"""The trie of conversation prefixes against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.llm import queries
from routeloom.llm.common import Scratch
from routeloom.llm.ordered import running
from routeloom.llm.prefix_trie import digests, positions, prefix_trie, rebuild

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out[m[0], len(p)] = (
            members[p[:-1]][0] if p else None, len(m), sum(len(q) == len(p) + 1 for q in inside), sum(map(leaf, inside)),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, heavy string")
    scratch = Scratch(spark)
    found = prefix_trie(rebuild(positions(df, scratch)), scratch)
    assert found.columns == NAMES
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len({r[:2] for r in got})
    return {r[:2]: r[2:] for r in got}


def test_unusual(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "é"])) for c in range(130) for t in range(r.randrange(1, 9))]
    rows += [(500, None, "user", "null turn first"), (500, 2, "user", "y"), (500, 2, "user", "x"), (500, 2, "user", "x"), (None, 1, "user", "no id"), (777, 1, "user", "w" * 100_000)]
    rows += [(1000, t, "user", str(t % 3)) for t in range(70)] + [(1000 + k, t, "user", str(t % 3)) for k in (1, 2, 3) for t in range(20 * k)]
    assert trie(spark, rows) == brute(rows)


def test_copies_and_chains(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(12)] + [(100 * c, t, "user", f"{t if t < c else -t}") for c in range(1, 20) for t in range(22)]
    assert trie(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert trie(spark, []) == {}


@pytest.mark.parametrize("xor", [False, True])
def test_running_totals_across_tasks(spark, xor):
    r = random.Random(1)
    rows = [(k, i, r.randrange(-(1 << 60), 1 << 60) if xor else i) for k, n in ((1, 5), (2, 3000), (3, 1), (4, 1), (5, 2500)) for i in range(n)]
    want, now, last = {}, 0, None
    for k, i, v in rows:
        now = v if k != last else (now ^ v if xor else now + v)
        want[k, i], last = now, k
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], [F.col("i")], ["v"], Scratch(spark), "t", xor=xor, keep=["i"])
        assert {(x.k, x.i): x.v for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_digest_of_a_large_node(spark):
    df = spark.range(0, 5000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("conv_id")).union(spark.sql("select 2L, 7L"))
    got = {r.k: r.ends_sha256 for r in digests(df, ["k"], Scratch(spark), chunk=64).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.SQL["op13_prefix_trie"])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(NAMES)
    want = sorted(want.fetchall(), key=str)
    got = sorted((tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, sf).select(columns).collect()), key=str)
    assert got == want
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert {r[:2]: r[2:] for r in (tuple(dict(zip(columns, x))[n] for n in NAMES) for x in got)} == brute(rows)
