"""Words one edit apart and their forms against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from routeloom.llm import spelling as s


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    out = Counter()
    for doc, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = [n, len(near)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], words[form[w]] if form[w] else None)
    return out


def test_wavelet_tree():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 301):
        values = r.permutation(n)
        cuts = np.sort(r.integers(0, n + 1, (2, 200)), axis=0), np.sort(r.integers(0, n + 1, (2, 200)), axis=0)
        q, v = s.WaveletTree(values).report(*cuts[0], *cuts[1])
        want = {(k, x) for k in range(200) for x in values[cuts[0][0][k] : cuts[0][1][k]].tolist() if cuts[1][0][k] <= x < cuts[1][1][k]}
        assert len(q) == len(want) and set(zip(q.tolist(), v.tolist(), strict=True)) == want


def crowd(r, n):
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 10))): r.choice([5, 6, 30, 200, 1000]) for _ in range(n)}
    return words | {"aaaaaa" + "".join(r.choice("abcde") for _ in range(6)): r.randrange(5, 99) for _ in range(n)} | {"x" * 3000: 9, "x" * 2999: 50, "y" + "x" * 2999: 7}


@pytest.mark.parametrize("rows", [7, 64, 1 << 17])
def test_near_words(spark, rows):
    words = crowd(random.Random(4), 300)
    got = {r.word: (r.n_near, r.near_n, r.near) for r in s.nearest(spark.createDataFrame([*words.items()], "word string, n long"), slice_rows=rows).collect()}
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), words[best], best)
    assert got == want


def test_variants(spark):
    r = random.Random(7)
    stems = ["".join(r.choice("aeiourstlnéÉ") for _ in range(r.randrange(5, 11))) for _ in range(40)]
    rows = [(k, " ".join(r.choice(stems[: 1 + r.randrange(40)]).capitalize() + r.choice(["", "", "", "s", "!", "ā"]) for _ in range(200))) for k in range(150)]
    rows += [(None, "stranger stranger " * 3), (-1, None), (0, ""), (3, " ".join(["repeated"] * 5000)), (3, "repeatad " * 6), (3, "repeatad " * 6), (4, "x" * 5000 + " "), (5, "ab2cdefgh×ij " * 5)]
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, n int, word string")
    found = s.spelling_variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(x) for x in found.collect()]
    words = brute_words(rows)
    assert len(got) == len(words) and {x[0]: x[1:] for x in got} == brute(words)
    assert any(x[1] and x[1] != x[2] for x in got) or any(x[1] for x in got)


def test_counts_in_small_holds(spark):
    rows = [(k, "lettersa lettersb lettersc " * (k % 3)) for k in range(30)]
    got = s.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), held=1).where("n >= 5")
    assert {x.word: x.n for x in got.collect()} == brute_words(rows)


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("a", "w3")], "word string, form string")
    assert {r.word: r.root for r in s.last_forms(forms).collect()} == {**{f"w{k}": "w11" for k in range(11)}, "a": "w11"}


def test_empty_table(spark):
    assert s.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf):
    from routeloom.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_spelling_variants"](spark, sf).collect()}
    assert set(got) == set(words)
    near = brute(words)
    assert got == near
