"""Operator 3: language identification with hyperdimensional profiles.

Every letter (and the word boundary) has a fixed random +1/-1 vector, drawn from a generator seeded
by its code point, so unseen scripts need no table. A trigram's vector binds its letters' vectors,
each permuted by its place: rho^2(a) * rho(b) * c. A text's profile bundles (adds) the vectors of
all its trigrams; a language's prototype bundles the profiles of its training documents. Texts are
compared with prototypes by cosine, after removing the mean prototype from both sides (the part
that all languages share).

Training is distributed and covers every training document: each task bundles per language in
64-bit integers, so sums do not depend on their order, and only (languages x DIM) numbers reach the
driver. Prediction is a dense product of trigram counts and trigram vectors in slices bounded by
bytes; a slice's distinct trigrams are taken in blocks.

Edge cases: null text, or a text without a letter, is ``und`` with score 0. Rows with a null lang
are never trained on. Without training rows everything is ``und``. Ties go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import annotate, as_bytes, crc_mod, slices

DIM = 512
SLICE_BYTES = 1 << 20
BLOCK = 8192
CACHED = 60_000  # trigram vectors kept by a worker
UNKNOWN = "und"
FIELDS = [("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())]

_LETTERS: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    v = _LETTERS.get(code)
    if v is None:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        v = _LETTERS[code] = np.random.default_rng([7, code]).integers(0, 2, DIM).astype(np.int8) * 2 - 1
    return v


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram number) of every trigram, and each number's key (three code points of 21 bits).

    Letters are lower-cased; anything else is a word boundary (code 0), runs of it count once.
    """
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    size = np.array([len(t) + 2 for t in lowered], np.int64)
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
    letters = np.array([0, *[c for c in seen.tolist() if chr(c).isalpha()]], np.int64)
    table = np.zeros(int(seen.max()) + 1 if len(seen) else 1, np.int32)
    table[letters[1:]] = np.arange(1, len(letters))
    sym = table[codes]
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    first = np.cumsum(size) - size
    keep[first] = True
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)[keep]
    sym, k = sym[keep], len(letters)
    if len(sym) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (sym[:-2].astype(np.int64) * k + sym[1:-1]) * k + sym[2:]
    inner = np.flatnonzero((doc[2:] == doc[:-2]) & (code > 0))
    code, doc = code[inner], doc[inner]
    if k**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(k**3, np.int32)
        place[used] = np.arange(len(used))
        number = place[code]
    else:
        used, number = np.unique(code, return_inverse=True)
    keys = (letters[used // (k * k)] << 42) | (letters[used // k % k] << 21) | letters[used % k]
    return doc, number, keys


class Vectors:
    """Trigram vectors by key, made when first asked for and kept up to CACHED of them."""

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.table = np.zeros((0, DIM), np.int8)

    def make(self, keys: np.ndarray) -> np.ndarray:
        letters, back = np.unique(np.stack((keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF)), return_inverse=True)
        back = back.reshape(3, -1)
        base = np.stack([letter_vector(c) for c in letters.tolist()])
        return np.roll(base, 2, 1)[back[0]] * np.roll(base, 1, 1)[back[1]] * base[back[2]]

    def get(self, keys: np.ndarray) -> np.ndarray:
        if len(keys) > CACHED:
            return self.make(keys)
        names = keys.tolist()
        new = [x for x in names if x not in self.row]
        if len(self.row) + len(new) > CACHED:
            self.row, self.table, new = {}, np.zeros((0, DIM), np.int8), names
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.concatenate((self.table, self.make(np.array(new, np.int64))))
        return self.table[[self.row[x] for x in names]]


VECTORS = Vectors()


def bundle(texts: list[bytes]) -> np.ndarray:
    """The profile of each text: the sum of its trigrams' vectors."""
    doc, number, keys = trigrams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for lo in range(0, len(keys), BLOCK):
        part = keys[lo:lo + BLOCK]
        at = np.flatnonzero((number >= lo) & (number < lo + BLOCK)) if len(keys) > BLOCK else slice(None)
        cell = doc[at].astype(np.int64) * len(part) + (number[at] - lo)
        counts = np.bincount(cell, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ VECTORS.get(part).astype(np.float32)
    return out.astype(np.float64)


class Counts:
    """Trigram counts of one language, folded when they grow; their bundle is one product."""

    def __init__(self) -> None:
        self.keys, self.n = [], []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        if sum(map(len, self.keys)) > 1 << 20:
            self.fold()

    def fold(self) -> None:
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.n = [keys], [np.bincount(back, np.concatenate(self.n)).astype(np.int64)]

    def bundle(self) -> np.ndarray:
        self.fold()
        total = np.zeros(DIM, np.int64)
        for lo in range(0, len(self.keys[0]), BLOCK):
            total += self.n[0][lo:lo + BLOCK] @ VECTORS.make(self.keys[0][lo:lo + BLOCK]).astype(np.int64)
        return total


def learn(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Prototypes by language over all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counts] = {}
        for b in batches:
            texts, langs = as_bytes(b.column(0)), b.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_BYTES):
                doc, number, keys = trigrams(texts[lo:hi])
                if not len(keys):
                    continue
                names = sorted(set(langs[lo:hi]))
                group = np.array([names.index(x) for x in langs[lo:hi]])
                n = np.bincount(group[doc] * len(keys) + number, minlength=len(names) * len(keys)).reshape(len(names), -1)
                for name, row in zip(names, n, strict=True):
                    some = np.flatnonzero(row)
                    sums.setdefault(name, Counts()).add(keys[some], row[some])
        for name, v in sums.items():
            if v.keys:
                yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v.bundle())], names=["lang", "dim", "v"])

    train = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 3) != 1))
    parts = train.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, dim int, v bigint")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["v"]
    return {k: v for k, v in out.items() if np.abs(v).sum() > 0}


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language and cosine score (0 to 1) for every row."""
    model = learn(df, id_col, text_col, lang_col)
    names = sorted(model)
    unit = np.stack([model[n] / np.linalg.norm(model[n]) for n in names]) if names else np.zeros((0, DIM))
    centre = unit.mean(0) if len(names) > 1 else np.zeros(DIM)
    proto = unit - centre
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)

    def make():
        def f(_, texts, held_out):
            profile = bundle(texts)
            length = np.linalg.norm(profile, axis=1, keepdims=True)
            blank = (length[:, 0] == 0) | (not names)
            profile = profile / np.maximum(length, 1e-12) - centre
            profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)
            cosine = np.round(profile @ proto.T, 9) if names else np.zeros((len(texts), 1))
            best = cosine.argmax(1)
            return {
                "held_out": held_out,
                "lang_pred": [UNKNOWN if x else names[k] for x, k in zip(blank, best, strict=True)],
                "score": np.where(blank, 0.0, np.clip((1 + cosine.max(1)) / 2, 0, 1)),
            }

        return f

    return annotate(df, id_col, text_col, FIELDS, make, SLICE_BYTES, {"held_out": crc_mod(id_col, 3) == 1})
