"""Operator 10: benchmark decontamination by the CGK random-walk embedding and bit-sampling LSH.

Texts are case-folded (all of Unicode) and white space runs become one space. An item is found wherever a document
span is within ``edits`` (a fraction) of the item's characters, at any character, by exact edit distance.

The embedding walks over a text with a step's random bit for each symbol: it writes the current symbol and moves on
or stays, so a few edits shift two walks only until they meet again and edit distance turns into Hamming distance.
A repetition has its own random bits and samples SAMPLES steps, spread evenly over the whole walk of an item; an
item-sized window of a document whose walk has the item's symbols at all of them collides, and windows that collide
in some repetition go on to the exact edit distance. There are as many repetitions as a simulation with copies of
these very items, edited in KINDS ways at the largest tolerated edit count, needs for the target recall (a tenth of
``target_recall``'s misses at most, as windows are few); if ``max_walks`` do not reach it, a warning gives the recall reached.
Unedited windows collide in every repetition.

Windows are embedded only where they can match: an item that tolerates k edits is cut into k + 1 pieces, of which one
survives k edits unchanged, so a window lines up with a surviving piece, shifted by at most k. Hashes of every document
position are looked up among the pieces; that loses no window within the tolerance, wherever it starts.

Where the tolerance leaves pieces under PIECE bytes (from some 11 % on), pieces say too little: windows then start at
every character and are compared with segments of SEGMENT bytes from every SMALL bytes of an item, by sampled steps
compared in stages, the early ones first, with up to ``max_repetitions`` repetitions.

Items are the stated query set: they are read in blocks of at most BLOCK_BYTES, each shipped whole
to the tasks after that check. Items under 16 bytes are found as exact substrings that do not cut a word
(scripts without spaces between words have no such bounds).

Edge cases: null or empty documents and items match nothing. Repeated document rows each report
their matches; of equal items each is reported.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import LOWER, as_bytes, mix64, same_schema, slices

EDITS = 0.04
TARGET_RECALL = 0.9
MAX_REPETITIONS = 8  # where windows start at every character
MAX_WALKS = 48  # where windows line up with pieces
SAMPLES = 4  # steps of a walk that are compared
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
SMALL = 16
PIECE = 8  # bytes of a piece that is worth a lookup
WIDTHS = (16, 12, 8)  # bytes of a piece that are hashed
GRAM = 4
CLASS = 1.25
SEGMENT = 4 * SMALL
KINDS = 6
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff"
EARLY, MIDDLE, LATE = (5, 16), (1, 48), 1  # samples and step bounds of the first two stages; samples of the last
FIELDS = [("item_id", T.LongType()), ("edits", T.LongType()), ("start", T.LongType()), ("length", T.LongType())]


def normal(text: bytes) -> bytes:
    if not text.isascii():
        return b" ".join(text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape").split())
    return b" ".join(text.translate(LOWER).split())


def class_of(size: int) -> int:
    """The largest class size that fits in an item."""
    return int(SMALL * CLASS ** math.floor(math.log(size / SMALL, CLASS) + 1e-9))


class Repetition:
    """Random walk bits and sampled steps of one repetition."""

    def __init__(self, seed: int, sizes: list[int]):
        rng = np.random.default_rng([11, seed])
        self.steps = 2 * max(sizes)
        self.bits = rng.integers(0, 2, (self.steps, 256)).astype(np.uint8)
        self.sample: dict[int, list[list[int]]] = {}
        early = sorted(rng.choice(EARLY[1], EARLY[0], replace=False).tolist())
        middle = sorted((EARLY[1] + rng.choice(MIDDLE[1] - EARLY[1], MIDDLE[0], replace=False)).tolist())
        spread = rng.random(LATE)
        for size in sorted(set(sizes)):
            last = 2 * size - 1
            cut = [[s for s in group if s < last * 0.9] for group in (early, middle)]
            low = max([*cut[0], *cut[1], 0]) + 1
            self.sample[size] = [*cut, sorted({min(last, int(low + u * (last - low))) for u in spread})]
        self.masks = []
        for lo in range(0, self.steps, 32):
            part = self.bits[lo:lo + 32].astype(np.uint32)
            self.masks.append((part << np.arange(len(part), dtype=np.uint32)[:, None]).sum(0).astype(np.uint32))

    def walk(self, text: np.ndarray, at: np.ndarray, begin: int, end: int, take: set[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Positions after steps begin..end-1 and the symbols written at the steps in take."""
        got: dict[int, np.ndarray] = {}
        at = np.minimum(at, len(text) - 1)  # the text ends in padding, on which a walk may stay
        dense = len(at) * 8 > len(text)
        table = shift = None
        for j in range(begin, end):
            if j in take:
                got[j] = text[at]
            if dense:
                if j % 32 == 0 or table is None:
                    table = self.masks[j // 32][text]
                    table[-1] = 0
                    shift = np.empty(len(at), np.uint32)
                np.take(table, at, out=shift, mode="clip")
                shift >>= np.uint32(j % 32)
                shift &= np.uint32(1)
                at += shift.view(np.int32)
            else:
                at += self.bits[j][text[at]]
                np.minimum(at, len(text) - 1, out=at)
        return at, got


def key_of(symbols: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(symbols[0]) if symbols else 1, salt * 2 + 1, np.uint64)
    for s in symbols:
        h = (h ^ s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def spot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & 0xFFFF


class Index:
    """Item keys of all repetitions; queried with window starts."""

    def __init__(self, items: list[tuple[int, bytes]], repetitions: int):
        self.items = [(i, t) for i, t in items if len(t) >= SMALL]
        self.tiny = [(i, t) for i, t in items if 0 < len(t) < SMALL]
        sizes = [class_of(len(t)) for _, t in self.items]
        self.reps = []
        gap = bytes(2 * max(sizes, default=1) + 2)
        text = np.frombuffer(b"".join(t + gap for _, t in self.items), np.uint8)
        start = np.cumsum([0, *[len(t) + len(gap) for _, t in self.items]])[:-1].astype(np.int32)
        for r in range(repetitions if self.items else 0):
            rep = Repetition(r, sizes)
            take = {s for groups in rep.sample.values() for g in groups for s in g}
            _, got = rep.walk(text, start, 0, rep.steps, take)
            stages = {}
            for size in sorted(set(sizes)):
                mine = np.flatnonzero(np.array(sizes) == size)
                keys, sofar = [], []
                for group in rep.sample[size]:
                    sofar = [*sofar, *[got[s][mine] for s in group]]
                    keys.append(key_of(sofar, size) if sofar else np.full(len(mine), size * 2 + 1, np.uint64))
                early = rep.sample[size][0]
                first = key_of([got[s][mine] for s in early], 0) if early else np.ones(1, np.uint64)
                stages[size] = (mine, keys, first)
            self.reps.append((rep, stages))

    def candidates(self, text: np.ndarray, start: np.ndarray) -> set[tuple[int, int]]:
        """(start, item number) pairs that collide in some repetition."""
        out: set[tuple[int, int]] = set()
        for rep, stages in self.reps:
            # sizes that share their first-stage samples share the walk and one filter
            families: dict[tuple, list[int]] = {}
            for size in stages:
                families.setdefault(tuple(rep.sample[size][0]), []).append(size)
            for early, sizes in families.items():
                flag = np.zeros(1 << 16, bool)
                # first-stage keys are made without the size, so one filter serves all sizes
                flag[spot(np.concatenate([stages[size][2] for size in sizes]))] = True
                for lo in range(0, len(start), 1 << 16):
                    mine = start[lo:lo + (1 << 16)]
                    at, got = rep.walk(text, mine, 0, max(early, default=-1) + 1, set(early))
                    h = key_of([got[s] for s in early], 0) if early else np.full(len(mine), 1, np.uint64)
                    hit = np.flatnonzero(flag[spot(h)])
                    if len(hit):
                        self._finish(rep, stages, sizes, text, mine[hit], at[hit], {s: got[s][hit] for s in early}, max(early, default=-1) + 1, out)
        return out

    def _finish(self, rep: Repetition, stages: dict, sizes: list[int], text: np.ndarray, start: np.ndarray, at: np.ndarray, got: dict, step: int, out: set) -> None:
        middle = sorted({s for size in sizes for s in rep.sample[size][1]})
        if middle:
            at, more = rep.walk(text, at, step, middle[-1] + 1, set(middle))
            got, step = got | more, middle[-1] + 1
        live = np.zeros(len(start), bool)
        for size in sizes:
            live |= np.isin(key_of([got[s] for g in rep.sample[size][:2] for s in g], size), stages[size][1][1])
        at, start, got = at[live], start[live], {s: v[live] for s, v in got.items()}
        late = sorted({s for size in sizes for s in rep.sample[size][2]})
        if not len(start):
            return
        for s in late:  # late samples may lie before the middle stage's end for the smallest classes
            if s < step and s not in got:
                got |= rep.walk(text, start, 0, s + 1, {s})[1]
        rest = {s for s in late if s >= step}
        if rest:
            got |= rep.walk(text, at, step, max(rest) + 1, rest)[1]
        for size in sizes:
            mine, keys = stages[size][0], stages[size][1]
            h = key_of([got[s] for g in rep.sample[size] for s in g], size)
            order = np.argsort(keys[2], kind="stable")
            lo, hi = np.searchsorted(keys[2][order], h), np.searchsorted(keys[2][order], h, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                for j in order[lo[k]:hi[k]].tolist():
                    out.add((int(start[k]), int(mine[j])))


def scores(item: str, text: str, free: bool) -> list[int]:
    """Edit distance of item to text[:j] for each j, or with free to the nearest text[i:j]. Bit-parallel columns."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, high, carry = (1 << m) - 1, 1 << (m - 1), 0 if free else 1
    pv, mv, score, out = full, 0, m, [m]
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        out.append(score)
        ph = ((ph << 1) | carry) & full
        mh = (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return out


def cuts(size: int, most: int) -> list[int]:
    """Bounds of most + 1 pieces; at most `most` edits leave one of them as it is."""
    return [size * i // (most + 1) for i in range(most + 2)]


def edit_distance(item: str, text: str, most: int) -> int | None:
    """Least edit distance between item and a prefix of text, or None above most."""
    if text.startswith(item):
        return 0
    at = cuts(len(item), most)
    if not any(item[a:b] in text for a, b in zip(at, at[1:], strict=False)):
        return None
    best = min(scores(item, text[:len(item) + most], False))
    return best if best <= most else None


def best_span(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the nearest span of text, the first of equal ones, or None above most."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    m = len(item)
    least = m - GRAM + 1 - most * GRAM  # grams of the item that `most` edits leave somewhere in the span
    if least > 0:
        grams = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
        if sum(item[i:i + GRAM] in grams for i in range(m - GRAM + 1)) < least:
            return None
    ends = scores(item, text, True)
    best = min(ends)
    if best > most:
        return None
    end = ends.index(best)
    back = scores(item[::-1], text[max(0, end - m - best):end][::-1], False)
    size = min((j for j, d in enumerate(back) if d == best), key=lambda j: abs(j - m))
    return best, end - size, end


class Pieces:
    """Pieces of the items by their hashed first bytes; queried with whole texts."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, t) in enumerate(items):
            bounds = piece_bounds(t, edits) or [0, len(t)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                rows.setdefault(next(w for w in WIDTHS if w <= b - a), []).append((k, a, b - a))
        self.tables = []
        for width, some in rows.items():
            part = np.array(some, np.int32)
            key = np.array([hashes(np.frombuffer(items[k][1][a:a + width], np.uint8), width)[0] for k, a, _ in some], np.uint64)
            order = np.argsort(key, kind="stable")
            bits = min(24, max(16, (64 * len(key)).bit_length()))
            flag = np.zeros(1 << bits, bool)
            flag[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((width, flag, bits, key[order], part[order]))

    def hits(self, text: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(position, item number, offset in the item, length) wherever a piece's first bytes occur."""
        for width, flag, bits, key, part in self.tables:
            for lo in range(0, len(text) - width + 1, 1 << 16):
                h = hashes(text[lo:lo + (1 << 16) + width - 1], width)
                at = np.flatnonzero(flag[(h >> np.uint64(64 - bits)).astype(np.int64)])
                h = h[at]
                first, last = np.searchsorted(key, h), np.searchsorted(key, h, side="right")
                for x in np.flatnonzero(last > first).tolist():
                    for k, offset, size in part[first[x]:last[x]].tolist():
                        yield lo + int(at[x]), k, offset, size


def piece_bounds(item: bytes, edits: float) -> list[int] | None:
    """Byte bounds of the item's pieces, or None if one is too short to be looked up."""
    word = item.decode("utf-8", "surrogateescape")
    at = cuts(len(word), int(edits * len(word)))
    size = np.cumsum([0, *[len(word[a:b].encode("utf-8", "surrogateescape")) for a, b in zip(at, at[1:], strict=False)]])
    return size.tolist() if np.diff(size).min() >= PIECE else None


def hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes (8 to 16) at each position."""
    text = np.ascontiguousarray(text)
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    n = len(text) - width + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[width - 8:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h


def bounded(item: bytes) -> re.Pattern:
    """Finds an item where it does not cut a word."""
    word = item.decode("utf-8", "surrogateescape")
    letter = f"[^\\W{SPACELESS}]"
    left, right = (bool(re.match(letter, c)) for c in (word[0], word[-1]))
    return re.compile((f"(?<!{letter})" if left else "") + re.escape(word) + (f"(?!{letter})" if right else ""))


class Lookup:
    """All that finds the items of a block: embedded windows, lined up with pieces or, where those are too short, at every character."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float, target: float, most: int, max_walks: int = MAX_WALKS):
        self.items = [(i, t) for i, t in items if len(t) >= SMALL]
        self.tiny = [(i, t, bounded(t)) for i, t in items if 0 < len(t) < SMALL]
        self.pieces = Pieces(self.items, edits)
        rest = [k for k, (_, t) in enumerate(self.items) if piece_bounds(t, edits) is None]
        block = [self.items[k] for k in rest]
        self.most = np.array([int(edits * len(t.decode("utf-8", "surrogateescape"))) for _, t in self.items], np.int64)
        paired = sorted(set(range(len(self.items))) - set(rest))
        aim = 1 - (1 - target) / 10
        walks, self.walk_recall = walk_recall([self.items[k][1] for k in paired], self.most[paired].tolist(), aim, max_walks)
        if self.walk_recall < aim:
            warnings.warn(f"{walks} walks reach a recall of {self.walk_recall:.3f} for edited copies of {len(paired)} items, the aim is {aim:.3f}; raise max_walks", stacklevel=2)
        self.walks = Walks([t for _, t in self.items], walks)
        self.short = np.isin(np.arange(len(self.items)), rest)
        repetitions, self.recall = calibrate(block, edits, target, most)
        if self.recall < target:
            warnings.warn(f"{repetitions} repetitions reach a recall of {self.recall:.2f} for edited copies of {len(block)} items, the target is {target}; raise max_repetitions", stacklevel=2)
        self.index = Index([((rest[k], a), t) for (k, a), t in segments(block)], repetitions) if block else None

    def spots(self, text: np.ndarray, joined: bytes, base: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, position, offset in the item that is at this position) of all candidates; base holds where documents begin."""
        places = set()
        for at, k, offset, size in self.pieces.hits(text):
            item = self.items[k][1]
            if joined[at:at + size] == item[offset:offset + size]:
                if joined.startswith(item, at - offset) if at >= offset else False:
                    yield k, at, offset  # an unedited window collides in every repetition
                elif not self.short[k] and self.most[k]:
                    places.add((k, at - offset))
        if places:
            k, start = np.array(sorted(places), np.int64).T
            # a shifted start can lie before the piece's document only where the piece itself tells which one it is
            d = np.clip(np.searchsorted(base, start + self.most[k], side="right") - 1, 0, len(base) - 2)
            of, at = windows_at(k, start, self.most[k], base[d], base[d + 1])
            hit = self.walks.collisions(text, k[of], at, base[d + 1][of]).any(1)
            for x in np.flatnonzero(hit).tolist():
                yield int(k[of[x]]), int(at[x]), 0
        if self.index:
            for at, j in self.index.candidates(text, characters(text)):
                k, offset = self.index.items[j][0]
                yield k, at, offset


class Walks:
    """CGK embeddings of items: in each repetition a walk's length and the hash of its sampled symbols."""

    def __init__(self, items: list[bytes], repetitions: int):
        self.repetitions = repetitions
        self.fraction = np.sort((np.arange(SAMPLES) + np.random.default_rng(7).random((repetitions, SAMPLES))) / SAMPLES, axis=1)
        self.size = np.array([len(t) for t in items], np.int64)
        self.length, self.key = np.zeros((len(items), repetitions), np.int32), np.zeros((len(items), repetitions), np.uint64)
        order = np.argsort(self.size, kind="stable").tolist()
        group: list[int] = []
        for n, k in enumerate(order):  # items of like size walk together, in groups of bounded bytes
            group.append(k)
            if len(group) * max(1, len(items[k])) > 1 << 18 or n + 1 == len(order):
                text = np.frombuffer(b"".join(items[k] for k in group) + b"\0", np.uint8)
                end = np.cumsum(self.size[group])
                rows = [np.repeat(x, repetitions) for x in (np.array(group), end - self.size[group], end)]
                r = np.tile(np.arange(repetitions), len(group))
                self.length[rows[0], r] = self._length(text, rows[1], rows[2], r)
                self.key[rows[0], r] = self._sampled(text, *rows, r)
                group = []

    @staticmethod
    def _bit(symbol: np.ndarray, r: np.ndarray, step: int) -> np.ndarray:
        """The random bit of a repetition, step and symbol."""
        return (mix64((r.astype(np.uint64) << np.uint64(40)) + np.uint64(step * 256) + symbol) >> np.uint64(40) & np.uint64(1)).astype(np.int64)

    def _length(self, text: np.ndarray, at: np.ndarray, end: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Steps until each walk has passed its text."""
        out, live, at, step = np.zeros(len(at), np.int32), np.arange(len(at)), at.copy(), 0
        while len(live):
            at += self._bit(text[at], r[live], step)
            step += 1
            done = at >= end[live]
            if done.any():
                out[live[done]] = step
                live, at = live[~done], at[~done]
        return out

    def _sampled(self, text: np.ndarray, item: np.ndarray, at: np.ndarray, end: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Hashes of the symbols that walks from at write at the sampled steps of their items."""
        out, hash_, live, at = np.zeros(len(at), np.uint64), np.ones(len(at), np.uint64), np.arange(len(at)), at.copy()
        want = (self.fraction[r] * self.length[item, r][:, None]).astype(np.int32)
        taken, step = np.zeros(len(at), np.int64), 0
        while len(live):
            symbol = np.where(at < end[live], text[np.minimum(at, len(text) - 1)], 0).astype(np.uint64)
            # steps of a short walk can fall together
            while len(hit := np.flatnonzero(want[live, np.minimum(taken[live], SAMPLES - 1)] == step)) and len(hit := hit[taken[live[hit]] < SAMPLES]):
                hash_[live[hit]] = mix64(hash_[live[hit]] * np.uint64(257) + symbol[hit])
                taken[live[hit]] += 1
            at += self._bit(symbol, r[live], step)
            step += 1
            going = taken[live] < SAMPLES
            if not going.all():
                out[live[~going]] = hash_[live[~going]]
                live, at = live[going], at[going]
        return out

    def collisions(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(windows, repetitions): whether the window from start collides with its item; end bounds its document."""
        n, m = len(item), self.repetitions
        out = np.zeros((n, m), bool)
        lot = max(1, (1 << 16) // m)
        for lo in range(0, n, lot):
            part = slice(lo, min(n, lo + lot))
            k, a, e = (np.repeat(x[part], m) for x in (item, start, end))
            r = np.tile(np.arange(m), len(k) // m)
            out[part] = (self._sampled(text, k, a, e, r) == self.key[k, r]).reshape(-1, m)
        return out


def windows_at(k: np.ndarray, start: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (index of the place, start) of the windows around places, shifted by up to `most` and inside their documents."""
    wide = 2 * most + 1
    of = np.repeat(np.arange(len(k)), wide)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide) - most[of]
    at = start[of] + shift
    ok = (at >= low[of]) & (at < high[of])
    return np.stack((of[ok], at[ok]))


def walk_recall(items: list[bytes], tolerated: list[int], target: float, most: int, trials: int = 204) -> tuple[int, float]:
    """Repetitions that reach the target for the worst kind of edits, and the recall of that simulation."""
    edges = [k for k, n in enumerate(tolerated) if n]
    if not edges:
        return 1, 1.0
    rng = np.random.default_rng(5)
    pick = np.array([edges[int(x)] for x in rng.integers(0, len(edges), trials)])
    copies = [edited(items[k], tolerated[k], rng, c % KINDS) for c, k in enumerate(pick)]
    around = [rng.integers(97, 123, 64).astype(np.uint8).tobytes() for _ in copies]  # copies stand in running text
    text = np.frombuffer(b"".join(x + c + x for c, x in zip(copies, around, strict=True)) + b"\0", np.uint8)
    end = np.cumsum([len(c) + 128 for c in copies])
    first = np.concatenate(([0], end[:-1]))
    own, back = np.unique(pick, return_inverse=True)
    walks = Walks([items[k] for k in own], most)
    of, at = windows_at(back, first + 64, np.array(tolerated)[pick], first, end)
    hit = walks.collisions(text, back[of], at, end[of])
    seen = np.zeros((trials, most), bool)
    np.logical_or.at(seen, of, hit)
    seen = np.logical_or.accumulate(seen, axis=1)
    recall = np.min([seen[kind::KINDS].mean(0) for kind in range(KINDS)], axis=0)
    enough = np.flatnonzero(recall >= target)
    r = int(enough[0]) if len(enough) else most - 1
    return r + 1, float(recall[r])


def edited(text: bytes, count: int, rng: np.random.Generator, kind: int = 0) -> bytes:
    """A copy with count edits: anywhere (0), near the start (1), a block replaced (2, 3) or deleted (4, 5) anywhere or at the start."""
    t = bytearray(text)
    if kind > 1:
        at = 0 if kind % 2 else int(rng.integers(0, max(1, len(t) - count)))
        t[at:at + count] = rng.integers(97, 123, count).astype(np.uint8).tobytes() if kind < 4 else b""
        return bytes(t)
    for _ in range(count):
        at, what = int(rng.integers(0, min(len(t), 2 * count) if kind else len(t))), int(rng.integers(0, 3))
        letter = bytes([int(rng.integers(97, 123))])
        t[at:at + (what != 1)] = b"" if what == 0 else letter
        if not t:
            t = bytearray(b"a")
    return bytes(t)


def segments(items: list[tuple[int, bytes]]) -> list[tuple[tuple[int, int], bytes]]:
    """((item number, offset), bytes) of the parts of items whose windows are compared, so edits at one place do not hide the item."""
    return [((k, a), t[a:a + SEGMENT]) for k, (_, t) in enumerate(items) for a in range(0, max(1, len(t) - SMALL + 1), SMALL)]


def characters(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero((text != 0) & ((text & 0xC0) != 0x80)).astype(np.int32)


def calibrate(items: list[tuple[int, bytes]], edits: float, target: float, most: int, trials: int = 204) -> tuple[int, float]:
    """Repetitions needed for the target, and the recall of a simulation with that many over all kinds of edits.

    The recall is that of the worst kind of edits."""
    some = [x for x in items if len(x[1]) >= SMALL and piece_bounds(x[1], edits) is None]
    if not some:  # pieces find every copy within the tolerance
        return 1, 1.0
    rng = np.random.default_rng(5)
    pick = [int(k) for k in rng.integers(0, len(some), trials)]
    limit = [int(edits * len(some[k][1].decode("utf-8", "surrogateescape"))) for k in pick]
    copies = [edited(some[k][1], n, rng, c % KINDS) for c, (k, n) in enumerate(zip(pick, limit, strict=True))]
    gap = bytes(1000)
    text = np.frombuffer(b"".join(c + gap for c in copies), np.uint8)
    base = np.cumsum([0, *[len(c) + len(gap) for c in copies]])
    start = characters(text)
    found, seen = [], np.zeros(trials, bool)
    index = Index(segments(some), most)
    reps = index.reps
    for r in range(most):
        index.reps = reps[r:r + 1]
        for at, j in index.candidates(text, start):
            k, offset = index.items[j][0]
            c = int(np.searchsorted(base, at, side="right")) - 1
            seen[c] |= pick[c] == k and abs(at - int(base[c]) - offset) <= 4 * limit[c]
        found.append(min(float(seen[kind::KINDS].mean()) for kind in range(KINDS)))
        if found[-1] >= target:
            break
    return len(found), found[-1]


def regions(starts: set[int], size: int, slack: int, text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of text that hold every span at these starts, whole characters, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for at in sorted(starts):
        lo, hi = max(0, at - slack), min(len(text), at + size + slack)
        while 0 < lo < len(text) and text[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def search(index: Lookup, texts: list[bytes], edits: float) -> list[list[tuple[int, int, int, int]]]:
    """For each normalised text its best match with every item: (item, edits, start, length) in normalised bytes."""
    out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    gap = bytes(8)
    joined = gap.join(texts) + gap
    a = np.frombuffer(joined, np.uint8)
    base = np.cumsum([0, *[len(t) + len(gap) for t in texts]])
    places: dict[tuple[int, int], set[int]] = {}
    for k, at, offset in index.spots(a, joined, base):
        d = int(np.searchsorted(base, at, side="right")) - 1
        places.setdefault((d, k), set()).add(at - int(base[d]) - offset)
    for (d, k), starts in sorted(places.items()):
        i, item = index.items[k]
        word = item.decode("utf-8", "surrogateescape")
        most = int(edits * len(word))
        for lo, hi in regions(starts, len(item), 4 * most, texts[d]):
            part = texts[d][lo:hi].decode("utf-8", "surrogateescape")
            got = best_span(word, part, most)
            if got is not None:
                start, end = (lo + len(part[:x].encode("utf-8", "surrogateescape")) for x in got[1:])
                if i not in out[d] or (got[0], start) < out[d][i][:2]:
                    out[d][i] = (got[0], start, end - start)
    for i, item, pattern in index.tiny:
        for d, t in enumerate(texts):
            if item in t and (m := pattern.search(part := t.decode("utf-8", "surrogateescape"))):
                out[d][i] = (0, len(part[:m.start()].encode("utf-8", "surrogateescape")), len(item))
    return [[(i, *v) for i, v in sorted(m.items())] for m in out]


def item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The query set in blocks whose bytes are bounded."""
    rows = items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    block, size = [], 0
    for i, text in rows.orderBy(item_id, item_text).toLocalIterator():
        t = normal(text.encode())
        if block and size + len(t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def indexes(items: DataFrame, item_id: str, item_text: str, edits: float, target: float, most: int) -> Iterator[Lookup]:
    for block in item_blocks(items, item_id, item_text):
        yield Lookup(block, edits, target, most)


def find_leaks(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    edits: float = EDITS, target_recall: float = TARGET_RECALL, max_repetitions: int = MAX_REPETITIONS,
) -> DataFrame:
    """(id, item_id, edits, start, length): one row for each document row and item it contains."""
    kind = next(f.dataType for f in df.schema.fields if f.name == id_col)
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(n, t) for n, t in FIELDS]])
    out = None
    for index in indexes(items, item_id, item_text, edits, target_recall, max_repetitions):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for b in batches:
                texts = as_bytes(b.column(1))
                for lo, hi in slices(texts, SLICE_BYTES):
                    found = search(shared.value, [normal(t) for t in texts[lo:hi]], edits)
                    at = [lo + d for d, m in enumerate(found) for _ in m]
                    rows = [x for m in found for x in m]
                    if rows:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(arrow.field(0).type), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], schema=arrow)

        part = df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    edits: float = EDITS, target_recall: float = TARGET_RECALL, max_repetitions: int = MAX_REPETITIONS,
) -> DataFrame:
    """The rows without any item, with all their columns as they are."""
    at = df.columns.index(text_col)
    for index in indexes(items, item_id, item_text, edits, target_recall, max_repetitions):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            def f(b: pa.RecordBatch) -> pa.RecordBatch:
                texts = as_bytes(b.column(at))
                kept = [not m for lo, hi in slices(texts, SLICE_BYTES) for m in search(shared.value, [normal(t) for t in texts[lo:hi]], edits)]
                return b.filter(pa.array(kept, pa.bool_()))

            return f

        df = same_schema(df, make)
    return df
