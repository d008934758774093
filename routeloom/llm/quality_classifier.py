"""Operator 2: quality classifier from weak labels.

Ten overlapping heuristics vote good, bad or abstain on every document (most only against it). The counts of vote patterns
over *all* documents (at most 3^10 rows, whatever the corpus) go to the driver, where expectation
maximisation estimates each labeller's accuracy and the class share, and with them the posterior of
every pattern. The posteriors label a bounded sample (``sample_docs`` documents expected, chosen by
hash of id and text, equal rows once) that trains a hashed linear scorer over words, word shapes and document traits; the
scorer then scores every document.

Edge cases: null or empty text has no words; it votes bad by length alone. Repeated rows get equal
scores. On an empty table nothing is learnt and nothing is returned.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import annotate

DIM = 1 << 16
SAMPLE_DOCS = 6000
LABELLERS = ["length", "word_size", "symbols", "upper", "dup_lines", "distinct", "marks", "digits", "short_words", "repeats"]
TRAIT_VALUE = 1.0  # of a document trait beside its words' mean
GOOD, BAD, NONE = 2, 1, 0
FIELDS = [("score", T.DoubleType()), ("posterior", T.DoubleType()), ("good", T.BooleanType()), ("votes", T.StringType())]
UPPER, DIGITS, MARKS, SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b"#*$%&|<>{}[]~^=_\\"


def by(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def traits(text: bytes, words: list[bytes]) -> list[float]:
    n, size = len(words), max(1, len(text))
    chars = sum(map(len, words))
    less = lambda drop: size - len(text.translate(None, drop)) if text else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        n, chars / max(1, n), less(SYMBOLS) / max(1, n), less(UPPER) / max(1, chars), 1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / max(1, n), less(MARKS) / max(1, n), less(DIGITS) / max(1, chars), sum(len(w) <= 3 for w in words) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n),
    ]


def votes(x: list[float]) -> list[int]:
    n = x[0]
    return [
        by(n, n >= 60, n < 5), by(x[1], False, x[1] < 3 or x[1] > 12), by(x[2], False, x[2] > 0.1), by(x[3], False, x[3] > 0.3), by(x[4], False, x[4] > 0.4),
        by(x[5], n >= 50 and x[5] > 0.4, n >= 50 and x[5] < 0.25), by(x[6], False, x[6] > 0.1), by(x[7], False, n >= 20 and x[7] > 0.2),
        by(x[8], 0.15 <= x[8] <= 0.6, n >= 20 and x[8] < 0.02), by(x[9], False, x[9] > 0.1),
    ]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """patterns (P, labellers) of votes, their counts -> posterior of "good" by pattern; vote tables (class, labeller, vote)."""
    # most heuristics look for one kind of defect, so a start where any bad vote counts separates the classes
    post = np.where((patterns == BAD).any(1), 0.05, 0.95)
    table = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        share = np.stack((1 - post, post)) * counts
        for v in range(3):
            table[:, :, v] = share @ (patterns == v)
        # a labeller's votes are taken to be better than chance: pseudo-counts favour agreement
        table += np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]])[:, None, :]
        prob = table / table.sum(2, keepdims=True)
        prior = (share.sum(1) + 1) / (share.sum() + 2)
        # an abstention says nothing: most heuristics only ever speak up against a document
        log = np.log(prior)[:, None] + sum(np.where(patterns[:, j] == NONE, 0, np.log(prob[:, j, patterns[:, j]])) for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, prob


def word_features(w: bytes) -> tuple[int, int]:
    form = bytes([min(len(w), 15), w[:1].isupper(), w.isupper(), w[-1:].isalnum()]) + (b"d" if w.translate(None, DIGITS) != w else b"") + w[-1:] * (not w[-1:].isalnum())
    return zlib.crc32(b"w" + w) % DIM, zlib.crc32(b"s" + form) % DIM


def trait_features(x: list[float]) -> list[int]:
    steps = [np.log2(1 + x[0]), x[1], 20 * x[2], 20 * x[3], 10 * x[4], 10 * x[5], 20 * x[6], 20 * x[7], 10 * x[8], 20 * x[9]]
    return [zlib.crc32(f"t{j}:{int(min(v, 40))}".encode()) % DIM for j, v in enumerate(steps)]


def fit(rows: list[tuple[list[int], list[float], float]], epochs: int = 20) -> np.ndarray:
    """Logistic regression on soft labels; rows are (features, values, posterior). The last weight is the bias."""
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    order = np.random.default_rng(3)
    for _ in range(epochs if rows else 0):
        at = order.permutation(len(rows))
        for lo in range(0, len(at), 256):
            part = [rows[i] for i in at[lo:lo + 256]]
            size = np.array([len(r[0]) for r in part])
            idx = np.concatenate([r[0] for r in part]).astype(np.int64)
            val, doc = np.concatenate([r[1] for r in part]), np.repeat(np.arange(len(part)), size)
            z = np.bincount(doc, w[idx] * val, len(part)) + w[DIM]
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[2] for r in part])
            grad = np.bincount(idx, err[doc] * val, DIM + 1) / len(part)
            grad[DIM] = err.mean()
            hot = np.flatnonzero(grad)
            g2[hot] += grad[hot] ** 2
            w[hot] -= 0.1 * grad[hot] / np.sqrt(g2[hot])
    return w.astype(np.float32)


def features(words: list[bytes], x: list[float]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array([word_features(w) for w in words], np.int64).reshape(-1, 2)
    own = np.concatenate((pairs.ravel(), np.array(trait_features(x), np.int64)))
    val = np.concatenate((np.full(pairs.size, 1 / max(1, len(words))), np.full(len(x), TRAIT_VALUE)))
    idx, back = np.unique(own, return_inverse=True)
    return idx, np.bincount(back, val)


def pattern(v: list[int]) -> str:
    return "".join(map(str, v))


def learn(df: DataFrame, id_col: str, text_col: str, sample_docs: int) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Posterior by vote pattern, labeller tables and scorer weights."""

    def vote_only():
        def f(_, texts):
            return {"votes": [pattern(votes(traits(t, t.split()))) for t in texts]}

        return f

    got = annotate(df, id_col, text_col, [("votes", T.StringType())], vote_only).groupBy("votes").count().collect()
    got = sorted((r["votes"], r["count"]) for r in got)
    table = np.array([[int(c) for c in p] for p, _ in got], np.int64).reshape(-1, len(LABELLERS))
    n = np.array([c for _, c in got], float)
    post, prob = expectation_maximisation(table, n) if got else (np.zeros(0), np.zeros((2, len(LABELLERS), 3)))
    posterior = {p: float(x) for (p, _), x in zip(got, post, strict=True)}
    mark = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(2**62 - 1))
    below = int(min(1.0, sample_docs / max(1.0, n.sum())) * 2**62)

    def sample():
        def f(_, texts, marks):
            out = {"h": marks, "idx": [], "val": [], "y": []}
            for t in texts:
                words = t.split()
                x = traits(t, words)
                idx, val = features(words, x)
                out["idx"].append(idx.astype(np.int32))
                out["val"].append(val.astype(np.float32))
                out["y"].append(posterior[pattern(votes(x))])
            return out

        return f

    kinds = [("h", T.LongType()), ("idx", T.ArrayType(T.IntegerType())), ("val", T.ArrayType(T.FloatType())), ("y", T.DoubleType())]
    some = df.where(mark < below) if below < 2**62 else df
    got = annotate(some, id_col, text_col, kinds, sample, extra={"mark": mark}).dropDuplicates(["h"]).select("h", "idx", "val", "y").collect()
    rows = [(r["idx"], r["val"], r["y"]) for r in sorted(got)]
    return posterior, prob, fit(rows)


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, least: float = 0.5) -> DataFrame:
    """Score (probability of good), weak-label posterior, verdict and votes for every row."""
    posterior, _, w = learn(df, id_col, text_col, sample_docs)

    def make():
        known: dict[bytes, float] = {}

        def f(_, texts):
            out = {n: [] for n, _ in FIELDS}
            for t in texts:
                words = t.split()
                x = traits(t, words)
                if len(known) > 400_000:
                    known.clear()
                for word in set(words).difference(known):
                    a, b = word_features(word)
                    known[word] = float(w[a]) + float(w[b])
                z = sum(map(known.__getitem__, words)) / max(1, len(words)) + TRAIT_VALUE * sum(float(w[i]) for i in trait_features(x)) + float(w[DIM])
                v = pattern(votes(x))
                s = round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)
                for name, value in zip(out, (s, posterior.get(v, 0.5), s >= least, v), strict=True):
                    out[name].append(value)
            return out

        return f

    return annotate(df, id_col, text_col, FIELDS, make)
