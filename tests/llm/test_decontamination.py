"""Decontamination: passages wherever they start, whatever their edits, against plain restatements."""

import random
import warnings

import numpy as np
import pytest

from routeloom.llm import decontaminate
from routeloom.llm.common import prepare


def leaks(spark, docs, items, **more):
    df = prepare(spark).createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench, **more).collect()}


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_passages_that_start_inside_a_token(spark):
    r = random.Random(3)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)]
    items = [prose(r, 25) for _ in range(12)] + ["".join(r.choice(signs) for _ in range(60)) for _ in range(12)] + ["漢字仮名"]
    docs, want = [], set()
    for i, item in enumerate(items):
        for before, after in (("Question:", "Answer"), ("<p class=x>", "</p>"), ("漢字かな" * 5, "漢字かな" * 5)):
            if i < 24 or before[0] == "漢":
                want.add((len(docs), i))
            docs.append(f"{prose(r, 5)} {before}{item}{after} {prose(r, 5)}" if before[0] != "漢" else before[1:] + item + after)
    got = leaks(spark, docs, items)
    assert {x for x in got if x[1] < 24} == {x for x in want if x[1] < 24}
    assert {x for x in want if x[1] == 24} <= set(got)
    for (d, i), x in got.items():
        text, item = docs[d].encode(), items[i].encode()
        assert (x.edits, x.start, x.length) == (0, text.index(item), len(item))


def test_spans_against_brute_force():
    r = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, t, k = "".join(r.choice("abc") for _ in range(r.randrange(1, 12))), "".join(r.choice("abc") for _ in range(r.randrange(0, 14))), r.randrange(0, 5)
        best = min(distance(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        got = decontaminate.best_span(a, t, k)
        assert (got is None) == (best > k)
        assert got is None or (got[0] == best and distance(a, t[got[1]:got[2]]) == best)


def hard(item, k, kind, r):
    """A copy with k edits at the worst places."""
    if kind == 0:
        return "".join(r.choice("qrstuvw") for _ in range(k)) + item[k:]
    if kind == 1:
        return item[k:]
    at = sorted(r.sample(range(2 * k), k))
    return "".join("#" if j in at else c for j, c in enumerate(item))


def test_edits_at_the_start(spark):
    r = random.Random(5)
    items = [prose(r, 40) for _ in range(30)]
    for edits, least in ((decontaminate.EDITS, 1.0), (0.15, 0.85)):
        docs = [f"{prose(r, 8)} {hard(item, int(edits * len(item)), kind, r)} {prose(r, 8)}" for item in items for kind in range(3)]
        docs += [prose(r, 60) for _ in range(30)]
        got = leaks(spark, docs, items, edits=edits)
        want = {(3 * i + kind, i) for i in range(30) for kind in range(3)}
        assert set(got) <= want and len(got) >= least * len(want)
        assert all(x.edits <= int(edits * len(items[i])) for (_, i), x in got.items())


def test_calibration_on_all_kinds_of_edits():
    r = random.Random(6)
    items = [(i, prose(r, 40).encode()) for i in range(30)]
    for edits in (0.15, 0.25):
        assert all(decontaminate.piece_bounds(t, edits) is None for _, t in items)
        assert decontaminate.calibrate(items, edits, 0.9, decontaminate.MAX_REPETITIONS)[1] >= 0.9


def test_capitals_of_all_alphabets(spark):
    items = ["Según la niñez, ¿qué canción española señaló el pingüino mañana? " * 2, "Ελληνικά: τους λόγους της σοφίας " * 3, "Была ли эта задача в наборе вопросов? " * 3, "Die Straße führt über große Flüsse " * 3]
    docs = [f"Question: {item.upper()}!" for item in items] + [f"x{item.lower()}x" for item in items]
    assert set(leaks(spark, docs, items)) == {(d, d % 4) for d in range(8)}
    assert decontaminate.normal("ÄÖ\n Ü".encode() + b"\xff") == "äö ü".encode() + b"\xff"


def test_missed_target_is_reported():
    r = random.Random(8)
    items = [(i, prose(r, 40).encode()) for i in range(20)]
    with pytest.warns(UserWarning, match="reach a recall of 0"):
        assert decontaminate.Lookup(items, 0.3, 0.999, 1).recall < 0.999
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert decontaminate.Lookup(items, 0.15, 0.9, 8).recall >= 0.9
        assert decontaminate.Lookup(items, decontaminate.EDITS, 1.0, 1).recall == 1.0


def test_unedited_short_items_in_running_text(spark):
    r = random.Random(9)
    items = list({prose(r, 6)[:n].strip() + "z" * 3 for n in (15, 17, 19) for _ in range(60)})
    docs = [f"{prose(r, 10)} {item} {prose(r, 30)}" for item in items]
    for edits in (decontaminate.EDITS, 0.3):
        assert {(i, i) for i in range(len(items))} <= set(leaks(spark, docs, items, edits=edits))


def test_walks_meet_again_after_edits():
    """The embedding itself: unedited windows collide everywhere, edited ones often, others hardly ever."""
    r, rng = random.Random(12), np.random.default_rng(12)
    items = [prose(r, 40).encode() for _ in range(30)]
    walks = decontaminate.Walks(items, 16)
    slow = []
    for k, t in enumerate(items):  # a plain walk, symbol by symbol
        for rep in range(16):
            at, seen, step = 0, [], 0
            while at < len(t):
                seen.append(t[at])
                at += int(walks._bit(np.array([t[at]], np.uint64), np.array([rep]), step)[0])
                step += 1
            h = np.ones(1, np.uint64)
            for f in walks.fraction[rep]:
                h = decontaminate.mix64(h * np.uint64(257) + np.uint64(seen[int(f * len(seen))]))
            slow.append(len(seen) == walks.length[k, rep] and h[0] == walks.key[k, rep])
    assert all(slow)

    def share(texts):
        a = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        end = np.cumsum([len(t) for t in texts])
        return walks.collisions(a, np.arange(len(texts)), end - np.array([len(t) for t in texts]), end).mean()

    near = [decontaminate.edited(t, 4, rng) for t in items]
    assert share(items) == 1 and share(near) > 0.15 and share(items[1:] + items[:1]) < 0.01
    least, recall = decontaminate.walk_recall(items, [int(0.04 * len(t)) for t in items], 0.99, 48)
    assert recall >= 0.99 and 1 < least <= 48


def test_candidates_come_through_the_walks(monkeypatch, spark):
    """Where no window collides, no edited passage is found: nothing goes around the embedding."""
    r = random.Random(13)
    item = prose(r, 40)
    doc = f"{prose(r, 8)} {hard(item, 3, 0, r)} {prose(r, 8)}"
    index = decontaminate.Lookup([(0, item.encode())], decontaminate.EDITS, 0.9, 8)
    assert decontaminate.search(index, [doc.encode()], decontaminate.EDITS)[0]
    monkeypatch.setattr(index.walks, "key", index.walks.key + np.uint64(1))
    assert not decontaminate.search(index, [doc.encode()], decontaminate.EDITS)[0]
