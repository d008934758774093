"""n-gram join against brute force over all pairs, and the pipeline's near-duplicate stage."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from routeloom.llm import ngram_join
from routeloom.llm.common import prepare
from routeloom.llm.components import components


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def texts(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    bases = [[r.choice(words) for _ in range(r.randrange(1, 60))] for _ in range(8)]
    common = [r.choice(words) for _ in range(30)]
    out = []
    for _ in range(n):
        t = list(r.choice(bases))
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t + (common if r.random() < 0.3 else [])).upper() if r.random() < 0.2 else " ".join(t))
    return out


@pytest.mark.parametrize("seed,k,percent,crowd,rounds", [(1, 4, 85, 64, 2), (2, 5, 80, 64, 2), (3, 4, 85, 2, 1), (4, 5, 80, 1, 1)])
def test_against_brute(spark, monkeypatch, seed, k, percent, crowd, rounds):
    """A low crowd bound compares components of a token first, the usual one joins nodes at once."""
    prepare(spark)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rows = list(enumerate(texts(seed))) + [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "One\tTWO"), (5, "one two"), (None, "one two"), (105, "x " * 3000), (106, "x " * 2999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as node", "2 as token").repartition(3)
    got = ngram_join.link(df, width=k, percent=percent)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, k, percent)


def test_clashing_names():
    """Two sets of one first name are told apart by the second."""
    rows = [(1, "a b c d e"), (2, "p q r s t"), (3, "a b c d e"), (4, "k l m n o")]
    first, second = (ngram_join.names_of(ngram_join.Shingler(4).sets([t.encode()])[0])[0] for _, t in rows[:2])
    assert ngram_join.node_of(ngram_join.Shingler(4).sets([rows[0][1].encode()])[0], frozenset([first])) != first
    assert ngram_join.node_of(ngram_join.Shingler(4).sets([rows[1][1].encode()])[0], frozenset([first])) == second


def test_keep_one(spark):
    prepare(spark)
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(3, a, "x"), (1, a, "y"), (1, a, "y"), (2, a + " z", "z"), (9, "other words are here now", "k"), (None, a, "n")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"), width=5, percent=80)
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 1, 9] and got.columns == ["doc_id", "text", "lang"]


def test_empty(spark):
    prepare(spark)
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed,slice_edges", [(0, 1 << 18), (1, 1)])
def test_chain_components(spark, seed, slice_edges):
    """Chains of 1000 in random order, with and without the folding inside tasks (one edge a slice: none)."""
    prepare(spark)
    n = 1000
    order = list(range(n))
    random.Random(seed).shuffle(order)
    rows = list(zip(order, order[1:], strict=False)) + [(5000, 5001), (5001, 5000), (7, 7), (6000, 6000)]
    random.Random(seed).shuffle(rows)
    edges = spark.createDataFrame(rows, "a long, b long").repartition(8 if seed else 2)
    got = {r.node: r.root for r in components(edges, slice_edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 5000: 5000, 5001: 5000}


def test_components_of_nothing(spark):
    prepare(spark)
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["double", "timestamp", "boolean"])
def test_ids_of_any_type(spark, kind):
    """Ids that Spark and Python print differently: the links are those of integer ids."""
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words), " ".join([*words[:60], "x", *words[61:]])]
    if kind != "boolean":
        texts += ["other words " + str(k) * 3 for k in range(3)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    to = {"double": F.col("k") * 1e7, "timestamp": F.timestamp_seconds(F.col("k") * 3600), "boolean": F.col("k") == 1}[kind]
    got = ngram_join.link(df.withColumn("doc_id", to)).select("doc_id", "component_id").collect()
    ids = sorted({r.doc_id for r in got})
    assert len(got) == len(texts) and {(r.doc_id, r.component_id) for r in got} == {(ids[0], ids[0]), (ids[1], ids[0]), *((i, i) for i in ids[2:])}
