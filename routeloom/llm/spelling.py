"""Spelling variants: words one edit apart, by two-dimensional range reporting on wavelet trees.

A word is a point: its rank in forward order and its rank in the order of reversed words. What has a
given prefix is an interval of the first order, what has a given suffix one of the second. So for
each edit position i of a word w the words that replace its character i, or that have one more
before it, are the points in prefix interval of w[:i] x suffix interval of w[i + 1:] (or w[i:]),
among the words of that one length. A wavelet tree over the reverse ranks in forward order reports
them; intervals that hold nothing but w itself are skipped. A deletion is another word's insertion.

Of two words one edit apart, one half is the same: words of m letters meet by their first m // 2
letters for edits behind them, by the rest for edits before. These groups are sorted by ranges, and a
task builds trees over slices of consecutive groups of one side and length (SLICE rows, SLICE_BYTES
letters). A group of more than SLICE words is dealt over several slices by a hash of the word, its
words searching in each. So no tree grows with the data, and no pair is lost.

Counting: occurrences are added up in each task first (at most HELD words in memory) and then exchanged.

Edge cases: a null or empty text has no words, a null doc_id counts as the empty text; repeated rows
count again; ties between forms go to the smaller word in code-point order; no documents, or no word
often enough, give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import LOWER, Scratch, as_bytes, reliable

DELETE_ONE_IN = 199
MIN_LETTERS, MIN_COUNT, TIMES = 6, 5, 5
HELD = 1 << 18
SLICE, SLICE_BYTES = 1 << 17, 1 << 22


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, delete_one_in: int = DELETE_ONE_IN, held: int = HELD) -> DataFrame:
    """word, n: lower-cased runs of letters with the planted deletions, of at least min_letters letters."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for key, text in zip(as_bytes(b.column(0)), as_bytes(b.column(1)), strict=True):
                before = zlib.crc32(key + b":")
                for word, n in Counter(runs.findall(text.translate(LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % delete_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_letters:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= held:
                    yield batch()
        if total:
            yield batch()

    found = df.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Over a permutation of 0..n-1: for each level, top bit first, how many ones stand before each place."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        self.depth = max(1, int(self.n - 1).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((self.n - int(before[-1]), before))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value in [low, high) at a place in [left, right), queries in arrays."""
        q, lo, hi, v = np.arange(len(left)), left, right, np.zeros(len(left), np.int64)
        for level, (zeros, before) in enumerate(self.levels):
            width = 1 << (self.depth - 1 - level)
            a, b = before[lo], before[hi]
            sides = []
            for at, to, base in ((lo - a, hi - b, v), (zeros + a, zeros + b, v + width)):
                on = (at < to) & (base < high[q]) & (base + width > low[q])
                sides.append((q[on], at[on], to[on], base[on]))
            q, lo, hi, v = (np.concatenate(x) for x in zip(*sides, strict=True))
        return q, v


def sorted_classes(letters: np.ndarray, is_point: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of zero-padded rows of letters: their order, common prefix with the row before in it, points before each place of it."""
    n, m = letters.shape
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{m}").ravel(), kind="stable")
    there = letters[order]
    differ = there[1:] != there[:-1]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
    points = np.zeros(n + 1, np.int64)
    np.cumsum(is_point[order], out=points[1:])
    return order, common, points


def intervals(order: np.ndarray, common: np.ndarray, points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the interval of points that share its first depth letters, as ranks among the points."""
    n = len(order)
    new = common < depth
    new[0] = True
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    ends = np.append(starts[1:], n)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    left[order], right[order] = points[starts[which]], points[ends[which]]
    return left, right


def near_pairs(words: list[bytes], m: int, is_point: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) one edit apart and the places of b in forward order: b is a point of m letters, a has m (then only a, b) or m - 1 (then also b, a).

    first_half: the edits behind the first m // 2 letters, else those before.
    """
    n = len(words)
    letters = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(n, m)
    back = np.frombuffer(b"".join(w[::-1].ljust(m, b"\0") for w in words), np.uint8).reshape(n, m)
    short = letters[:, m - 1] == 0
    forward, reverse = sorted_classes(letters, is_point), sorted_classes(back, is_point)
    place = np.empty(n, np.int64)
    place[forward[0]] = np.arange(n)
    nothing = np.empty(0, np.int64)
    if not is_point.any():
        return nothing, nothing, place
    at_reverse = reverse[0][is_point[reverse[0]]]  # points by reverse rank
    rank = np.empty(n, np.int64)
    rank[at_reverse] = np.arange(len(at_reverse))
    tree = WaveletTree(rank[forward[0][is_point[forward[0]]]])
    own = is_point.astype(np.int64)
    found = []
    for i in range(m // 2, m) if first_half else range(m // 2):
        left, right = intervals(*forward, i)
        low, high = intervals(*reverse, m - 1 - i)
        ask = np.flatnonzero((right - left > own) & (high - low > own))
        q, v = tree.report(left[ask], right[ask], low[ask], high[ask])
        a, b = ask[q], at_reverse[v]
        # one more letter: the same word may come from several positions, the first of them counts
        keep = (a != b) & (~short[a] | (letters[b, i] != letters[b, i - 1] if i else True))
        found.append((a[keep], b[keep]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    more = short[a]
    return np.concatenate([a, b[more]]), np.concatenate([b, a[more]]), place


def nearest(words: DataFrame, slice_rows: int = SLICE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """word, n_near, near_n, near (the near word of largest n) of (word, n), for words with a near word.

    Words are of letters up to U+00FF.
    """
    size = F.length("word")
    half = lambda m: F.floor(m / 2).cast("int")
    part = lambda side, m, key, point: F.struct(F.lit(side).alias("side"), m.cast("int").alias("m"), F.xxhash64(key).alias("g"), F.lit(point).alias("point"))
    col, end = F.col("word"), F.lit(1 << 30)
    spread = words.select("word", "n", F.explode(F.array(
        part(0, size, F.substring(col, F.lit(1), half(size)), True), part(1, size, F.substring(col, half(size) + 1, end), True),
        part(0, size + 1, F.substring(col, F.lit(1), half(size + 1)), False), part(1, size + 1, F.substring(col, half(size + 1), end), False),
    )).alias("p")).select("word", "n", "p.*")
    group = ["side", "m", "g"]
    crowded = spread.where("point").groupBy(*group).agg(F.count("*").alias("k")).where(F.col("k") > slice_rows)
    crowded = crowded.select(*group, F.ceil(F.col("k") / slice_rows).cast("int").alias("salts"))
    dealt = spread.join(crowded, group, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))
    dealt = dealt.select("word", "n", *group, "point", "own", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = dealt.select(*group, "salt", "word", "n", (F.col("point") & (F.col("own") == F.col("salt"))).alias("point"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        rows, now, last = 0, None, None

        def report() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            names = [w.encode("latin-1") for part in held for w in part[0]]
            count, point = (np.concatenate([part[k] for part in held]) for k in (1, 2))
            held.clear()
            rows = 0
            a, b, place = near_pairs(names, now[1], point, now[0] == 0)
            if len(a):
                by = np.lexsort((place[b], -count[b], a))
                a, b = a[by], b[by]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                many = np.diff(np.append(first, len(a)))
                text = lambda x: pa.array([names[k].decode("latin-1") for k in x], pa.string())
                yield pa.RecordBatch.from_arrays([text(a[first]), pa.array(many.astype(np.int64)), pa.array(count[b[first]]), text(b[first])], names=["word", "k", "near_n", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            new = np.empty(batch.num_rows, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = last is None or tuple(key[:, 0].tolist()) != last
            last = tuple(key[:, -1].tolist())
            words_, n, point = batch.column(4).to_pylist(), batch.column(5).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            lo = 0
            for at in cuts:
                if at > lo:
                    held.append((words_[lo:at], n[lo:at], point[lo:at]))
                    rows += at - lo
                    lo = at
                if at == batch.num_rows:
                    break
                kind = tuple(key[:2, at].tolist())
                if now is not None and held and (kind != now or rows >= slice_rows or rows * now[1] >= slice_bytes):
                    yield from report()
                now = kind
        if held:
            yield from report()

    ranged = dealt.repartitionByRange(*group, "salt").sortWithinPartitions(*group, "salt")
    found = ranged.mapInArrow(run, "word string, k long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the forms followed to the last, by doubling; a form is more frequent than its word, so none comes back."""
    near = reliable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = near.join(near.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        step = reliable(step)
        near = step.drop("went")
        if not step.where("went").limit(1).count():
            return near


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row for each word of at least min_count occurrences."""
    scratch = Scratch(df.sparkSession)
    words = scratch.save("words", word_counts(df, id_col, text_col).where(F.col("n") >= min_count))
    near = words.join(nearest(words), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    near = scratch.save("near", near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    roots = last_forms(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


__all__ = ["WaveletTree", "last_forms", "near_pairs", "nearest", "spelling_variants", "word_counts"]
