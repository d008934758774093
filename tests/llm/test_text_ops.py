"""Operators on single texts against brute force: quality rules, personal data, tokens, language, classifier."""

import hashlib
import itertools
import json
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest

from routeloom.llm import bpe, language_id, pii, quality_classifier, quality_rules
from routeloom.llm.common import prepare

EDGE = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "w " * 20000, "d"), (4, "w " * 20000, "d"), (None, "some text here", None)]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def edge(spark):
    return prepare(spark).createDataFrame(EDGE, SCHEMA).selectExpr("*", "1 as n_words", "true as kept", "'x' as spans", "0.5 as score", "1 as n_tokens")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return prepare(spark).read.parquet(f"{sf}/documents.parquet")


def test_edges(edge):
    for f in (quality_rules.quality_rules, pii.find_pii, bpe.round_trip, language_id.identify, quality_classifier.classify):
        assert f(edge).count() == len(EDGE)
        assert f(edge.limit(0)).count() == 0
    assert quality_rules.keep_good(edge).columns == edge.columns and pii.mask_pii(edge).count() == len(EDGE)


def test_edge_values(edge):
    """Null, empty, blank, very long and repeated rows, and a null id, each with its stated result."""
    none = hashlib.sha256(b"").hexdigest()
    by = lambda df: sorted(((r.doc_id or 0, r) for r in df.collect()), key=lambda x: x[0])
    rows = by(quality_rules.quality_rules(edge))
    assert [(i, r.n_words, r.word_chars, r.n_repeat_words, r.kept) for i, r in rows] == [(0, 3, 12, 0, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), *[(4, 20000, 20000, 20000, False)] * 2]
    assert all((r.base_sha256, r.spans, r.n_added) == (none, "", 0) for _, r in by(pii.find_pii(edge)))
    rows = by(bpe.round_trip(edge))
    assert [r.n_tokens for _, r in rows][1:3] == [0, 0] and rows[4][1] == rows[5][1]
    assert [r.decoded_sha256 for _, r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in sorted((i or 0, t) for i, t, _ in EDGE)]
    rows = by(language_id.identify(edge))
    assert [r.lang_pred for _, r in rows][1:4] == ["und"] * 3 and all(0 <= r.score <= 1 for _, r in rows)
    rows = by(quality_classifier.classify(edge))
    assert [r.votes[0] for _, r in rows] == ["1", "1", "1", "1", "2", "2"] and rows[4][1] == rows[5][1] and all(0 <= r.score <= 1 for _, r in rows)


def test_expectation_maximisation():
    """Against one weight an example: patterns are counts of rows, and the posterior is each row's own Bayes rule."""
    r = np.random.default_rng(2)
    good = r.random(4000) < 0.7
    right = np.array([0.9, 0.8, 0.7, 0.95])
    rows = np.where(r.random((4000, 4)) < 0.3, quality_classifier.NONE, np.where((r.random((4000, 4)) < right) == good[:, None], quality_classifier.GOOD, quality_classifier.BAD))
    patterns, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post, prob = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    q = post[back.ravel()]
    assert abs(q.mean() - 0.7) < 0.05 and np.corrcoef(q, good)[0, 1] > 0.8
    for j, a in enumerate(right):  # the accuracies of the labellers, where they vote
        assert abs(prob[1, j, 2] / prob[1, j, 1:].sum() - a) < 0.06 and abs(prob[0, j, 1] / prob[0, j, 1:].sum() - a) < 0.06
    share = np.stack((1 - q, q))
    table = np.stack([[[share[c, rows[:, j] == v].sum() for v in range(3)] for j in range(4)] for c in range(2)]) + np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]])[:, None, :]
    assert np.allclose(table / table.sum(2, keepdims=True), prob, atol=1e-6)  # a fixed point of the plain step


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, hit = len(words), set()
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_rules(docs):
    want = {r.doc_id: rules(r.text) for r in docs.collect()}
    for r in quality_rules.quality_rules(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_repeat_lengths():
    r = random.Random(1)
    for _ in range(60):
        docs = [[r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(0, 30))] for _ in range(r.randrange(1, 5))]
        words, doc = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and i + k < len(d) and j + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert quality_rules.repeat_lengths(words, doc).tolist() == want


def base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.RANK[s[2]]))


def test_base_spans():
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice(r.choice(["0123456789", " .@-+", "ab1.@é"])) for _ in range(r.randrange(0, 60)))
        assert pii.base_spans(t) == base(t)
    assert pii.base_spans("1" * 200_000 + "@" * 50_000) == []  # linear time


def test_pii_query(docs):
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        b = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in b) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for s, e, k in b} <= set(r.spans.split(","))


def test_skip_chain_consistency(docs):
    model = pii.learn(docs)
    text = "write bosbt.42@mail8.example.com or call +1 (988) 555-2485 and later bosbt.42 or (988) 555-2485 again"
    found, more = pii.find_all(text, model, pii.THRESHOLD)
    assert {k for _, _, k in found} == {"email", "phone"} and ("email" in {k for _, _, k in more})
    assert pii.find_all("version 3.2.1 of 1999, page 12", model, pii.THRESHOLD)[1] == []
    assert "@" not in pii.masked(text, found + more) and "555-2485 and" not in pii.masked(text, found + more)


def test_field_marginals():
    """Chains and trees: the exact marginals by enumeration. A small loop: close to them."""
    r = np.random.default_rng(3)
    for edges, tolerance in (([(0, 1, 0), (1, 2, 0), (2, 3, 1)], 1e-3), ([(0, 1, 0), (0, 2, 1), (0, 3, 1)], 1e-3), ([(0, 1, 0), (1, 2, 0), (0, 2, 1)], 0.1)):
        n = 1 + max(v for _, v, _ in edges)
        model = {"w": r.normal(size=(pii.DIM, pii.LABELS)), "edge": r.normal(size=(2, pii.LABELS, pii.LABELS)) * 0.7}
        feats, masks = [[i, 50 + i] for i in range(n)], [31, 3, 31, 21][:n]
        want = np.zeros((n, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=n):
            if all(m >> k & 1 for m, k in zip(masks, y, strict=True)):
                e = sum(model["w"][f, k].sum() for f, k in zip(feats, y, strict=True)) + sum(model["edge"][t, y[u], y[v]] for u, v, t in edges)
                want[range(n), y] += np.exp(e)
        want /= want.sum(1, keepdims=True)
        assert np.abs(pii.marginals(model, feats, masks, edges) - want).max() < tolerance


def test_missed_mentions_are_added(docs):
    """Numbers that run into each other fail the base patterns as a whole; the field finds both parts, and nothing in decoys."""
    model = pii.learn(docs.sparkSession.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    good, found, wrong = 0, 0, 0
    r = random.Random(9)
    for _ in range(200):
        card = next(c for c in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), "") if pii.luhn(c))
        phone = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        text = f"Sint onre {phone} {card} the ereha of"
        base, more = pii.find_all(text, model, pii.THRESHOLD)
        want = {(10, 10 + len(phone), "phone"), (11 + len(phone), 11 + len(phone) + 16, "card")}
        good, found, wrong = good + len(want), found + len(want & set(base + more)), wrong + len(set(more) - want)
        decoy = f"Licensed under CC BY-NC {r.randrange(1, 9)}.0, version {r.randrange(10)}.{r.randrange(10)}.{r.randrange(10)}, of {r.randrange(1900, 2030)}"
        wrong += len(pii.find_all(decoy, model, pii.THRESHOLD)[1])
    assert found >= 0.9 * good and wrong <= 0.02 * good


def test_repeats_carry_labels(docs):
    """A mention without a telling context of its own gets the label of its distant repeat."""
    model = pii.learn(docs)
    first = "er +1 (269) 555-3296 of the onth"
    text = first + " word" * 300 + " 12692 555-3296"
    nodes = pii.candidates(text, pii.base_spans(text))
    feats, edges = pii.graph(text, nodes)
    masks = [1 << (pii.RANK[x[4]] + 1) if x[4] else x[3] for x in nodes]
    at = max(i for i, x in enumerate(nodes) if text[x[0]:x[1]] == "555-3296")
    alone = [e for e in edges if e[2] == 0]
    assert any(e[2] == 1 and at in e[:2] for e in edges)
    assert pii.marginals(model, feats, masks, edges)[at, 4] > pii.marginals(model, feats, masks, alone)[at, 4]


def test_tokens(docs):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = ref.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_stream_is_bounded(monkeypatch):
    """Long pieces of every class, cut anywhere: the library's ids, with a buffer that never grows."""
    tokenizers = pytest.importorskip("tokenizers")
    ref, t = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Transducer(open(bpe.default_path(), "rb").read())
    r = random.Random(5)
    words = [w for w in (t.token[i].decode("utf-8", "ignore") for i in range(300, 40000, 7)) if w.isalpha()]
    texts = ["x<|endoftext|> 's'll 　é🙂\t\n" * 3000, "!" * 9000 + "'s " + "\n" * 9000 + "z", " " * 9000, " " * 9000 + "\n", "\n \n" * 4000 + "'ll"]
    for n in (1, 300, 5000, 20000):
        texts += ["a" * n, "".join(r.choice("aehtin") for _ in range(n)), "7" * n, "".join(r.choice(words) for _ in range(n // 5)), " ".join(r.choice(words) for _ in range(n // 9))]
    merge, most = t.merge, [0]

    def watched(parts):
        most[0] = max(most[0], *map(len, parts))
        return merge(parts)

    monkeypatch.setattr(t, "merge", watched)
    for chunk, window in ((1 << 16, 1 << 12), (997, 64), (13, 4)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "WINDOW", window)
        for text, ids in zip(texts, t.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids
            assert t.decode(ids) == text
    assert most[0] <= t.window


def test_tokens_leave_early():
    """Tokens of an unfinished piece are emitted once their own lookahead has been read."""
    t = bpe.transducer(open(bpe.default_path(), "rb").read())
    r = random.Random(1)
    held, seen, out = b"", 0, 0
    for _ in range(200):
        part = "".join(r.choice("etaoinshr") for _ in range(100)).encode()
        ids, held = t.step(held, part, False)
        seen, out = seen + len(part), out + sum(len(t.token[i]) for x in ids for i in x.tolist())
        assert out + len(held) == seen and len(held) < t.window
    assert out > 0.8 * seen


def test_lookahead_decides_on_ordinary_text(monkeypatch):
    """All text takes the transducer's transitions: with no lookahead at all, tokens of ordinary words leave too early."""
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    raw = open(bpe.default_path(), "rb").read()
    text = "The quick brown foxes don't jump over 1234 lazy dogs, do they? " * 3
    want = ref.encode(text, add_special_tokens=False).ids
    t = bpe.Transducer(raw)
    assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == want
    assert t.states == 1 + len({p[:k] for p in bpe.PIECES.findall(text) for k in range(1, len(p) + 1)})
    hasty = bpe.Transducer(raw)
    hasty.look[:] = 0
    assert np.frombuffer(hasty.encode([text])[0], "<u4").tolist() == hasty.byte_id[np.frombuffer(text.encode(), np.uint8)].tolist()
    forgetful = bpe.Transducer(raw)
    monkeypatch.setattr(bpe, "STATES", 1)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    assert np.frombuffer(forgetful.encode([text])[0], "<u4").tolist() == want


def test_transitions_that_let_go_in_a_piece():
    """Short lookaheads, computed for a small list of merges, let tokens go inside short pieces; the ids are those of the whole."""
    raw = json.load(open(bpe.default_path()))
    model = raw["model"]
    base = {k: v for k, v in model["vocab"].items() if len(k) == 1}
    merges, vocab = ["a b", "c d", "ab cd", "b c", "e e", "d ee"], dict(base)
    for k, m in enumerate(merges):
        vocab[m.replace(" ", "")] = len(base) + k
    spec = {**raw, "added_tokens": [], "model": {**model, "vocab": vocab, "merges": merges}}
    t, r, early = bpe.Transducer(json.dumps(spec).encode()), random.Random(3), 0
    for _ in range(300):
        word = "".join(r.choice("abcdef") for _ in range(r.randrange(1, 40)))
        out, fresh = [], {}
        t.run([word], out, fresh)
        t.settle(list(fresh.values()))
        early += len(out) - 1
        assert np.frombuffer(b"".join(x if type(x) is bytes else x[bpe.ENDS] for x in out), "<u4").tolist() == t.merge([word.encode()])[0].tolist()
    assert early > 300


def test_pieces_go_on_together():
    """One more character of all pieces at a time: the interpreter's calls do not grow with the pieces (8000) or the new states (29,498)."""
    t, r, calls = bpe.Transducer(open(bpe.default_path(), "rb").read()), random.Random(7), []
    t.encode(["some"])  # with what is made once
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 12))) for _ in range(8000))
    for made, most in ((True, 25_000), (False, 2000)):
        before = t.states
        sys.setprofile(lambda *x: calls.append(x[1]) if x[1].endswith("call") else None)
        try:
            t.encode([text])
        finally:
            sys.setprofile(None)
        assert (t.states > before + most) == made and len(calls) < most
        calls.clear()


def test_states_are_due_by_their_own_tokens():
    """A state is looked at for tokens that may leave only from where a token that it begins with has its lookahead."""
    t, r = bpe.Transducer(open(bpe.default_path(), "rb").read()), random.Random(9)
    look = {x: int(n) for x, n in zip(t.token, t.look, strict=True) if len(x) + n <= 4 * bpe.SHORT}
    pieces = ["".join(r.choices("etaoin ABC.,09éж🙂", k=r.randrange(1, 20))) for _ in range(300)] + ["e" * 40]
    t.walk(pieces)
    states = np.arange(1, t.states)
    data, size = t._held(states)
    for s, held in zip(states.tolist(), np.split(data, np.cumsum(size)[:-1]), strict=True):
        held = held.tobytes()
        assert t.kept["due"][s] == min([k + look[held[:k]] for k in range(1, len(held) + 1) if held[:k] in look], default=bpe.BEYOND)


def test_odd_texts_together(monkeypatch):
    """Many short texts of mixed alphabets in one call, with states kept, few kept, and pieces above and below SHORT: the library's ids."""
    tokenizers = pytest.importorskip("tokenizers")
    ref, raw, r = tokenizers.Tokenizer.from_file(bpe.default_path()), open(bpe.default_path(), "rb").read(), random.Random(11)
    alphabets = ["ab", "etaoin shrdlu", "é🙂漢字ñßжш", "0123 .,-'", "\u0301\u200d🏽🙂", "\t\n \xa0\u3000\x00", "'s't're've'm'll'd"]
    for short, states in ((64, 800_000), (64, 300), (3, 800_000)):
        monkeypatch.setattr(bpe, "SHORT", short)
        monkeypatch.setattr(bpe, "STATES", states)
        t = bpe.Transducer(raw)
        for chunk in (5, 50, 1 << 16):
            monkeypatch.setattr(bpe, "CHUNK", chunk)
            texts = ["".join(r.choices("".join(r.sample(alphabets, r.randrange(1, 4))), k=r.choice([0, 1, 2, 5, 30, 200]))) for _ in range(150)]
            texts += [x + "<|endoftext|>" + x for x in texts[:10]]
            for text, ids in zip(texts, t.encode(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids


def test_table_of_keys():
    """Against a dictionary: keys of few slots, in batches, some replaced."""
    r, table, want = np.random.default_rng(3), bpe.Table(2), {}
    for size in (1, 3, 500, 0, 4000):
        keys = np.unique(r.integers(0, 9000, size) << 40)
        values = r.integers(-9, 9, len(keys)).astype(np.int32)
        table.put(keys, values)
        want |= dict(zip(keys.tolist(), values.tolist(), strict=True))
        asked = np.arange(9000) << 40
        assert table.get(asked, 99).tolist() == [want.get(k, 99) for k in asked.tolist()] and table.n == len(want)


def test_unsupported_settings():
    spec = json.load(open(bpe.default_path()))
    for part, key, value in (("model", "ignore_merges", True), ("pre_tokenizer", "add_prefix_space", True), ("model", "type", "Unigram")):
        odd = json.loads(json.dumps({k: v for k, v in spec.items() if k != "model"} | {"model": {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}}))
        odd[part][key] = value
        with pytest.raises(ValueError):
            bpe.checked(odd)
    with pytest.raises(ValueError):
        bpe.checked(spec | {"normalizer": {"type": "NFC"}})
    assert bpe.checked(spec) is spec


def test_token_columns(docs):
    ids = bpe.encode_column(docs)
    back = {r.doc_id: r.text for r in bpe.decode_column(ids).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_language(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_profile():
    for text in ("", "Hello, wörld!!  x", "12 34", "ab", "中文 字"):
        code = []
        for ch in f" {text.lower()} ":
            if ch.isalpha():
                code.append(ord(ch))
            elif not code or code[-1]:
                code.append(0)
        want = np.zeros(language_id.DIM)
        for a, b, c in zip(code, code[1:], code[2:]):
            want += np.roll(language_id.letter_vector(a), 2) * np.roll(language_id.letter_vector(b), 1) * language_id.letter_vector(c)
        assert np.abs(language_id.bundle([text.encode()])[0] - want).max() == 0


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_classifier.classify(prepare(spark).read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, bad = [s for s, q in labels if q == 1], [s for s, q in labels if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.85


def test_many_addresses_in_one_text():
    """Mentions of 2000 addresses' local parts are sought in one pass, with the boundaries of a plain pattern for each."""
    r = random.Random(6)
    names = [f"user{k}.{r.choice(['ann', 'Bob', 'xx-y'])}" for k in range(2000)]
    text = " ".join(f"{n}@example.com wrote to {r.choice(names).upper()}{r.choice(['', '.', '.x', '-', ',', '@'])} ({r.choice(names)})" for n in names)
    start = time.perf_counter()
    got = {x[:3] for x in pii.candidates(text, []) if "@" not in x[2]}
    assert time.perf_counter() - start < 2
    few = {n.lower() for n in names[:40]}
    plain = {(m.start(), m.end(), n) for n in few for m in re.finditer(rf"(?<![A-Za-z0-9._%+@-]){re.escape(n)}(?![A-Za-z0-9_%+@-]|\.[A-Za-z0-9])", text, re.IGNORECASE)}
    assert {x for x in got if x[2] in few} == plain and len(plain) > 30
