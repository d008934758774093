"""Corpus-wide operators against brute force: context trees, repeated strings, shards, decontamination."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from routeloom.llm import ctw, decontaminate, sharding, suffix_dedup
from routeloom.llm.common import prepare


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_tree(train, depth, test):
    count, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(t):
        a = [255] * depth + list(t) + [255]
        for i in range(depth, len(a)):
            for k in range(8):
                yield [tuple(a[i - j] for j in range(1, d + 1)) for d in range(depth + 1)], (1 << k) | (a[i] >> (8 - k)), (a[i] >> (7 - k)) & 1

    for t in train:
        for path, m, b in steps(t):
            for d, s in enumerate(path):
                count[s, m][b] += 1
                if d:
                    kids[path[d - 1], m].add(s)
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    memo = {}

    def weight(s, m):
        if (s, m) not in memo:
            e = kt(count[s, m])
            memo[s, m] = e if len(s) == depth else np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(weight(c, m) for c in kids[s, m]))
        return memo[s, m]

    out = []
    for t in test:
        total = 0
        for path, m, b in steps(t):
            p = 0.5
            for s in path[::-1]:
                if sum(count.get((s, m), (0, 0))):
                    n = count[s, m]
                    w = 1 if len(s) == depth else math.exp(min(0, math.log(0.5) + kt(n) - weight(s, m)))
                    p = w * (n[b] + 0.5) / (sum(n) + 1) + (1 - w) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_context_tree(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abC é\n") for _ in range(r.randrange(0, 30)))) for i in range(40)] + [(50, None), (51, ""), (3, "repeat of an id"), (None, "no id")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as block").repartition(3)
    name = lambda i: b"" if i is None else str(i).encode()
    train = [lower(t).encode() for i, t in rows if zlib.crc32(name(i)) % 5 != 1]
    want = brute_tree(train, ctw.DEPTH, [lower(t).encode() for _, t in rows])
    count = collections.Counter(w for t in train for w in re.findall(rb"[^\x20\x09-\x0D]+", t))
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    expected = collections.Counter()
    for (i, t), s in zip(rows, want, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [*[count[w] for w in words], len(train)])
        expected[(i, zlib.crc32(name(i)) % 5 == 1, len(words) + 1, sum(count[w] > 0 for w in words) + 1, total, round(base, 6), round(s, 6))] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ctw.score(df, block_bytes=200).collect())
    assert got == expected
    assert ctw.score(df.limit(0)).count() == 0


def test_context_tree_learns(spark):
    """A megabyte of training text already gives a code near the word model's, far below 8 bits a byte."""
    got = [r for r in ctw.score(prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > 1.05 * sum(r.base_score for r in got)
    assert sorted(r.bits_per_byte for r in got)[len(got) // 2] < 2.6


def test_merge_keeps_order_and_lengths():
    r = random.Random(1)
    for _ in range(100):
        runs = []
        for _ in range(r.randrange(1, 7)):
            s = sorted(bytes(r.choice(b"ab") for _ in range(6)) for _ in range(r.randrange(0, 8)))
            runs.append((s, [0, *[suffix_dedup.common(x, y, 0) for x, y in zip(s, s[1:])]][: len(s)]))
        order, lcp = suffix_dedup.merge(runs)
        text = [runs[i][0][j] for i, j in order]
        assert text == sorted(x for s, _ in runs for x in s) and lcp[1:] == [suffix_dedup.common(x, y, 0) for x, y in zip(text, text[1:])]


def brute_repeats(texts, n):
    count = collections.Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((len(t), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("n,gram", [(40, 16), (25, 25)])
def test_repeats(spark, n, gram):
    r = random.Random(4)
    al = "abcdefgh é"
    parts = ["".join(r.choice(al) for _ in range(60)) for _ in range(5)]
    texts = ["".join(r.choice(parts)[r.randrange(0, 30):r.randrange(30, 60)] if r.random() < 0.5 else "".join(r.choice(al) for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(0, 9))) for _ in range(80)]
    texts += ["a" * 90, "ab" * 60, texts[0], texts[0], "", "x" * 39, "x" * 40, "y" * 3000]
    rows = [*enumerate(texts), (999, None)]
    df = prepare(spark).createDataFrame([*rows, (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 as rid", "2 as block").repartition(3)
    want = collections.Counter((i, *x) for (i, _), x in zip([*rows, (0, "")], brute_repeats([*[(t or "").encode() for _, t in rows], texts[0].encode()], n), strict=True))
    got = suffix_dedup.remove_repeats(df, length=n, gram=gram, block_bytes=2000)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_shards(spark, tmp_path, sf):
    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    store = sharding.ShardStore(spark, str(tmp_path), target_bytes=1 << 20, fanout=2)
    for k in range(5):
        store.append(docs.where(f"doc_id % 5 = {k}"), rows_per_shard=10)
        store.compact()
    live = store.manifest()
    assert store.read().exceptAll(docs).count() == 0 and docs.exceptAll(store.read()).count() == 0
    assert sum(s.rows for s in live) == docs.count() and not sharding.plan(live, 1 << 20, 2)
    version = store.versions()[-1]
    with pytest.raises(sharding.Conflict):
        store.commit(version - 1, live)  # another writer was first
    assert not [f for f in tmp_path.joinpath("manifest").iterdir() if f.name.startswith(".draft") or f.name.startswith("..draft")]
    got = sharding.compact_documents(docs.withColumn("tier", docs.doc_id), str(tmp_path / "q"))
    assert got.select("doc_id").distinct().count() == docs.count() == got.count()
    assert sharding.compact_documents(docs.limit(0), str(tmp_path / "e")).count() == 0


def test_shards_of_two_writers(spark, tmp_path, monkeypatch):
    """An append that loses is committed again; readers keep their version until its time is over."""
    df = prepare(spark).createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "y"), (3, "long " * 50000, "z")], "doc_id long, text string, shard string")
    first, second = (sharding.ShardStore(spark, str(tmp_path), target_bytes=1 << 20, fanout=2) for _ in range(2))
    commit = first.commit

    def late(base, shards):
        monkeypatch.setattr(first, "commit", commit)
        second.append(df.where("doc_id = 2"))
        return commit(base, shards)

    monkeypatch.setattr(first, "commit", late)
    assert first.append(df) == 2
    want = df.unionAll(df.where("doc_id = 2"))
    reader, seen = first.read(2), first.manifest(2)
    while first.compact() == 2:
        first.append(df.limit(0).unionAll(df.where("doc_id = 1").repartition(4)))
        want = want.unionAll(df.where("doc_id = 1"))
    got = first.read()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert reader.count() == 6
    first.vacuum(now=time.time() + sharding.KEEP_SECONDS + 5)
    assert first.versions() == [first._current()]
    assert not {s.path for s in seen} - {s.path for s in first.manifest()} & {str(p) for p in tmp_path.rglob("*.parquet")}
    out = sharding.compact_documents(df, str(tmp_path / "q"), keep_seconds=0).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 250000)]


def test_tiers():
    top = sharding.sealed_tier(128 << 20, 4)
    sizes = [1 << 10, 1 << 18, 1 << 20, 4 << 20, 16 << 20, 64 << 20, 500 << 20]
    tiers = [sharding.tier_of(s, 128 << 20, 4) for s in sizes]
    assert tiers == sorted(tiers) and tiers[-1] == tiers[-2] == top and tiers[-3] < top


def distance(a, t):
    row = list(range(len(t) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    r = random.Random(1)
    for _ in range(1500):
        a, t, k = ("".join(r.choice("abc") for _ in range(r.randrange(lo, hi))) for lo, hi in ((1, 9), (0, 12))), None, r.randrange(0, 5)
        a, t = a
        best = distance(a, t[: len(a) + k])
        assert decontaminate.edit_distance(a, t, k) == (best if best <= k else None)


def test_leaks(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randrange(15, 60)).capitalize()) for i in range(40)] + [(90, "tiny one"), (91, None), (92, "")]
    rng = np.random.default_rng(1)
    docs, planted, edited = [], set(), set()
    for d in range(300):
        text = say(r.randrange(5, 200))
        if d % 3 == 0:
            i, item = items[r.randrange(40)]
            planted.add((d, i))
            text = f"{say(3)}\n{item} {text}"
        elif d % 3 == 1:
            i, item = items[r.randrange(40)]
            edited.add((d, i))
            text = f"{say(3)} {decontaminate.edited(item.lower().encode(), int(0.03 * len(item)), rng).decode()} {text}"
        docs.append((d, text))
    docs += [(1000, None), (1001, ""), (1002, "a tiny one here"), (1003, "word " * 30000)]
    df = prepare(spark).createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as edits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert planted <= got and (1002, 90) in got and got <= planted | edited | {(1002, 90)}
    assert len(edited & got) >= 0.85 * len(edited)
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_calibration_reaches_target():
    r = random.Random(9)
    items = [(i, "".join(r.choice("abcdefghij klm") for _ in range(200)).encode()) for i in range(30)]
    assert decontaminate.calibrate(items, 0.0, 0.99, 3) == (1, 1.0)
    assert decontaminate.calibrate(items, decontaminate.EDITS, 0.9, decontaminate.MAX_REPETITIONS)[1] >= 0.85
