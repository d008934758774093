"""Operator 8: quality rules with suffix-array repetition.

The words of a slice of documents are ranked together; the suffix array over words is built by
prefix doubling on the ranks, and only suffixes that still share a rank with another one are sorted
again. Ranks start from (document, word), so no comparison ever crosses documents. The kept rank
tables give the common-prefix length of neighbours in the suffix array by binary descent, and the
larger of a suffix's two neighbour lengths is the depth of the deepest common-prefix interval it
belongs to, i.e. the length of the longest repeated word string that starts there. The union of
these spans is the union of all occurrences of all maximal repeated strings of the minimum length.

Verdict: a document is rejected when the repeated strings of at least ``min_words`` words cover more
than ``max_fraction`` of its word characters, or when the longest one takes more than
``longest_fraction`` of its words (and has at least ``longest_words`` words).

Edge cases: null or empty text has no words, all counts are 0 and it is rejected (fewer than 20
words). Repeated rows are judged one by one. A text of any length is taken whole.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from routeloom.llm.common import annotate, as_bytes, same_schema, slices, spans_union

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 8
MAX_FRACTION = 0.25
LONGEST_FRACTION = 0.20
LONGEST_WORDS = 16
BASE_MIN_WORDS = 20
BASE_REPEAT_PERCENT = 30
SLICE_BYTES = 1 << 20

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("repeat_fraction", T.DoubleType()), ("longest_repeat", T.LongType()),
]


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest word string starting there that occurs again in its document.

    words, doc: equally long integer arrays; doc is non-decreasing.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    first = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(first, kind="stable")
    sorted_key = first[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    # a rank is the number of suffixes before the group; one more entry stands for "past the end"
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    ends = np.searchsorted(doc, doc, side="right")  # end of each position's document
    tables, h, sa = [rank.astype(np.int32)], 1, order
    while True:
        alone = new & np.concatenate((new[1:], [True]))
        at = np.flatnonzero(~alone)
        if len(at) == 0:
            break
        pos = sa[at]
        after = pos + h
        second = np.where(after < ends[pos], rank[np.minimum(after, n)], -1)
        key = rank[pos] * np.int64(n + 1) + (second + 1)
        by = np.argsort(key, kind="stable")
        key = key[by]
        sa = sa.copy()
        sa[at] = pos[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new = new.copy()
        new[at] = fresh
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = rank.copy()
        rank[sa[at]] = start[at]
        h *= 2
        tables.append(rank.astype(np.int32))
        if h > n:
            break
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: of the suffixes at places i-1 and i
    a, b = sa[:-1].copy(), sa[1:].copy()
    live = np.flatnonzero(doc[a] == doc[b]) if n > 1 else np.zeros(0, np.int64)
    a, b = a[live], b[live]
    a0 = a.copy()
    for k in range(len(tables) - 1, -1, -1):
        step = 1 << k
        inside = (a + step <= ends[np.minimum(a, n - 1)]) & (b + step <= ends[np.minimum(b, n - 1)]) & (a < n) & (b < n)
        inside &= (doc[np.minimum(a, n - 1)] == doc[a0]) & (doc[np.minimum(b, n - 1)] == doc[a0])
        same = np.zeros(len(a), bool)
        w = np.flatnonzero(inside)
        same[w] = tables[k][a[w]] == tables[k][b[w]]
        a = np.where(same, a + step, a)
        b = np.where(same, b + step, b)
    lcp[1:n][live] = a - a0
    out = np.empty(n, np.int64)
    out[sa] = np.maximum(lcp[:n], lcp[1:])
    return out


def measure(
    texts: list[bytes], min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION,
    longest_fraction: float = LONGEST_FRACTION, longest_words: int = LONGEST_WORDS,
) -> dict[str, np.ndarray]:
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = [w for s in split for w in s]
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    width = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))
    chars = width[words] if len(words) else words
    doc = np.repeat(np.arange(len(texts)), sizes)
    length = repeat_lengths(words, doc)
    n, at = len(words), np.arange(len(words))

    def covered(least: int) -> np.ndarray:
        hit = np.flatnonzero(length >= least)
        return spans_union(at[hit], at[hit] + length[hit], n)

    total = lambda v: np.bincount(doc, v, minlength=len(texts)).astype(np.int64)
    base = covered(8)
    cover = base if min_words == 8 else covered(min_words)
    word_chars = total(chars)
    n_repeat, cover_chars = total(base), total(chars * cover)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, length)
    lines = []
    for t in texts:
        full = [x for x in t.split(b"\n") if x.strip()]
        lines.append(len(full) - len(set(full)))
    failed = (sizes < BASE_MIN_WORDS) | (100 * n_repeat > BASE_REPEAT_PERCENT * sizes)
    fraction = cover_chars / np.maximum(word_chars, 1)
    bad = (fraction > max_fraction) | ((longest >= longest_words) & (longest > longest_fraction * sizes))
    return {
        "n_words": sizes, "word_chars": word_chars,
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": n_repeat, "base_failed": failed,
        "kept": ~failed & ~bad, "repeat_fraction": fraction, "longest_repeat": longest,
    }


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """Measures and verdict for every row. No shuffle: each document is judged by itself."""
    return annotate(df, id_col, text_col, FIELDS, lambda: lambda _, texts: measure(texts, **limits), SLICE_BYTES)


def keep_good(df: DataFrame, text_col: str = "text", **limits: float) -> DataFrame:
    """The rows that pass, with all their columns as they are."""
    at = df.columns.index(text_col)

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(b.column(at))
            kept = [measure(texts[lo:hi], **limits)["kept"] for lo, hi in slices(texts, SLICE_BYTES)]
            return b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

        return f

    return same_schema(df, make)
