"""Operator 5: byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

The merge list of a public tokenizer file fixes two bounds. The split pattern looks at most three
characters ahead, so a piece is final once that many characters follow it. Inside a piece, a merge
rule (a, b) can be pre-empted only if the right spine of b is consumed by a rule of higher
priority, which in turn can be pre-empted only by one of still higher priority; the longest such
chain, in bytes, is the *sufficient lookahead*, and each token has its own, from the rules whose left
side is on its right spine: a token with that many bytes behind its end never changes.

Every text goes through one transducer, chunk by chunk: the splitter keeps at most an unfinished
piece of WINDOW characters and a chunk, longer pieces stay open and pass through a buffer of at most
``window`` bytes, from whose front tokens are emitted as soon as they are stable. What is emitted is
consumed at once (digests, counts, the decoder), so memory does not grow with texts, pieces or
results. The transducer reads character by character, one more character of all pieces of a slice at
a time. Its state is what it holds: the bytes of the piece that no token has taken yet; a character
leads to another state and lets go the tokens that have become stable, the end of the piece lets go
the rest. States are made as texts need them and kept, as those of a lazily determinised automaton,
up to STATES of them (then all are forgotten and made anew): rows of arrays, with one table from state
and character to the next state. What holds more than SHORT characters goes on without being kept,
window by window. The decoder maps ids to bytes and bytes to text by an incremental UTF-8 state
machine, which keeps at most three pending bytes between tokens.

Edge cases: null counts as empty (no ids). The special token's own string inside a text is one id,
as the library encodes it. A malformed byte decodes to U+FFFD. Repeated rows are encoded each. A
tokenizer file with settings other than byte-level BPE without normalizer is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import annotate

# Fixed by the byte-level format: the split pattern and the byte alphabet.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PIECE_LOOKAHEAD = 3
CHUNK = 1 << 19  # characters of a text that go on together
SHORT = 64  # characters that a kept state of the transducer holds at most
STATES = 800_000  # kept states, some 100 bytes each
STAGE_STATES = 100_000  # those that a worker keeps between slices where other work follows in it
CHAR_BITS = 21  # of a character in a transition's key
BEYOND = 1 << 30  # the lookahead of what is no token
NEW = -(2**31)  # in place of a transition that is not made yet
ENDS = -1  # an end that is not settled yet
STATE = np.dtype([("parent", "i4"), ("char", "i4"), ("depth", "i2"), ("size", "i2"), ("due", "i4"), ("hash", "u8"), ("at", "i4"), ("n", "i4")])
LEAVING = np.dtype([("at", "i4"), ("n", "i4"), ("to", "i4")])
FACTOR, KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**63 - 1)
SLICE_BYTES = 2 << 20
NO_RANK = np.int32(2**31 - 1)
WINDOW = 1 << 12  # characters from which an unfinished piece is handed on in parts
# an open piece goes on as long as its own class of characters does
RUNS = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\p{White_Space}\p{L}\p{N}]*", r"\p{White_Space}*")]
SPACE = 3
# Fixed by the file format: settings that this transducer implements, anything else would change ids.
SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}

FIELDS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def byte_alphabet() -> dict[str, int]:
    """Character of the file format -> byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Cuts one text, fed in chunks, into pieces; its memory is a chunk and an unfinished piece."""

    def __init__(self, special: regex.Pattern | None, longest: int):
        self.special, self.longest = special, longest
        self.tail, self.held, self.open = "", "", None
        self.odd = False  # whether the last chunk gave anything but whole pieces

    def feed(self, chunk: str, last: bool) -> list:
        """Pieces (strings), special strings in a list of one, and parts (string, whether it ends its piece) of open pieces."""
        out: list = []
        self.odd = self.open is not None
        if self.special is None:
            self._segment(chunk, last, out)
            self.odd |= self.open is not None
            return out
        parts = self.special.split(self.tail + chunk)
        for k in range(0, len(parts) - 1, 2):
            self._segment(parts[k], True, out)
            out.append([parts[k + 1]])
        self.odd |= len(parts) > 1
        rest = parts[-1]
        keep = 0 if last else min(len(rest), self.longest - 1)
        self.tail = rest[len(rest) - keep:]
        self._segment(rest[:len(rest) - keep], last, out)
        self.odd |= self.open is not None
        return out

    def _segment(self, text: str, end: bool, out: list) -> None:
        s, self.held = self.held + text, ""
        if self.open is not None:
            n = RUNS[self.open].match(s).end()
            last = self.open == SPACE  # the last of several white spaces may belong to what follows
            if n == len(s) and not end:
                cut = max(0, n - last)
                out.append((s[:cut], False))
                self.held = s[cut:]
                return
            cut = n if end and n == len(s) else max(0, n - last)
            out.append((s[:cut], True))
            s, self.open = s[cut:], None
        if end:
            out += PIECES.findall(s)
            return
        if len(s) <= PIECE_LOOKAHEAD:
            self.held = s
            return
        found = list(PIECES.finditer(s))
        n = len(found) - 1
        while n > 0 and found[n - 1].end() > len(s) - PIECE_LOOKAHEAD:
            n -= 1
        out += [m.group() for m in found[:n]]
        rest = s[found[n].start():]
        if n == len(found) - 1 and len(rest) > WINDOW:
            self.open = next(k for k, r in enumerate(RUNS) if r.fullmatch(rest[-1]))
            cut = len(rest) - (self.open == SPACE)
            out.append((rest[:cut], False))
            rest = rest[cut:]
        self.held = rest


def is_short(piece: object) -> bool:
    return type(piece) is str and len(piece) <= SHORT


def checked(spec: dict) -> dict:
    """The tokenizer file, refused where a setting would make other ids."""
    for part, want in SETTINGS.items():
        have = spec.get(part)
        wrong = have is not None if want is None else [k for k, v in want.items() if (have or {}).get(k) != v and not (v is None or v is False) or (have or {}).get(k) not in (None, False, v)]
        if wrong:
            raise ValueError(f"tokenizer file: unsupported {part} {wrong if want else have}")
    odd = [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if odd:
        raise ValueError(f"tokenizer file: unsupported added tokens {odd}")
    return spec


def hashed(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of strings that go on with these bytes."""
    return (key * FACTOR + byte + np.uint64(1)) & KEY


class Table:
    """Open-addressed table of non-negative 64-bit keys, read and written by arrays of them."""

    def __init__(self, bits: int = 12):
        self.n, self.mask, self.shift = 0, (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * FACTOR) >> self.shift).view(np.int64)

    def get(self, key: np.ndarray, none: int) -> np.ndarray:
        slot = self._slot(key)
        got = self.keys[slot]
        hit = got == key
        out = np.where(hit, self.values[slot], np.int32(none))
        todo = np.flatnonzero(~hit & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys; the value of one that is there is replaced."""
        if 3 * (self.n + len(key)) > len(self.keys):
            old = self.keys != -1
            keys, values = self.keys[old], self.values[old]
            self.__init__(int(4 * (self.n + len(key))).bit_length())
            self.put(keys, values)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            here = self.keys[slot] == key
            self.values[slot[here]] = value[here]
            self.n += int((free & here).sum())
            key, value, slot = key[~here], value[~here], (slot[~here] + 1) & self.mask


def room(rows: np.ndarray, n: int) -> np.ndarray:
    """The array with space for n rows."""
    return rows if n <= len(rows) else np.concatenate([rows, np.zeros(max(n, len(rows) * 3 // 2) - len(rows), rows.dtype)])


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of these ranges, one range after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Transducer:
    def __init__(self, raw: bytes):
        spec = checked(json.loads(raw))
        of = byte_alphabet()
        vocab = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for k, v in vocab.items():
            self.token[v] = k
        for k, v in self.special.items():
            self.token[v] = k.encode()
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [tuple(vocab[bytes(of[c] for c in x)] for x in m) for m in pairs]
        self.left, self.right = (np.array([p[i] for p in ids], np.int64) for i in (0, 1))
        self.made = np.array([vocab[self.token[a] + self.token[b]] for a, b in ids], np.int32)
        rule, first = np.unique((self.left << 20) | self.right, return_index=True)
        self.rules = Table()
        self.rules.put(rule, first.astype(np.int32))
        self.byte_ranks = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.parts = {int(m): (int(a), int(b)) for m, a, b in reversed(list(zip(self.made, self.left, self.right, strict=True)))}
        self.lookahead = self._lookahead()
        self.window = 2 * (self.lookahead + max(map(len, self.token)))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.longest = max(map(len, self.special), default=1)
        self.length = np.array([len(x) for x in self.token], np.int64)
        self._forget()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rules.get((a.astype(np.int64) << 20) | b, NO_RANK)

    def _lookahead(self) -> int:
        """Bytes behind which any token is final (the longest chain of pre-empting rules), and each token's own in ``look``."""
        best: dict[int, int] = {}
        most = 0
        for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
            reach, x = 0, b
            while True:
                reach = max(reach, best.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
            need = len(self.token[b]) + reach
            best[a] = max(best.get(a, 0), need)
            most = max(most, need)
        self.look = np.zeros(len(self.token), np.int64)
        for t in range(len(self.token)):
            x = t
            while True:
                self.look[t] = max(self.look[t], best.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
        return most

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        ids, n = self._merge(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64))
        ends = np.cumsum(n).tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def _merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words of these sizes, one word after the other, and their number in each: all words merged together, one rank a round and word."""
        sym, word = self.byte_id[data], np.repeat(np.arange(len(size), dtype=np.int32), size)
        rank = np.full(len(sym), NO_RANK, np.int32)
        rank[:-1] = np.where(word[1:] == word[:-1], self.byte_ranks[data[:-1].astype(np.int32) << 8 | data[1:]], NO_RANK)
        ids, of = [sym[:0]], [word[:0]]
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.concatenate((start, [len(sym)])))
            best = np.repeat(low, length)
            live = best != NO_RANK
            if not live.all():
                ids.append(sym[~live])
                of.append(word[~live])
                sym, word, rank, best = sym[live], word[live], rank[live], best[live]
            hit = rank == best
            # of overlapping occurrences in a run of one symbol, every second one counts from the left
            idx = np.arange(len(sym), dtype=np.int32)
            run = idx - np.maximum.accumulate(np.where(hit, -1, idx))
            take = np.flatnonzero(hit & (run & 1 == 1))
            sym[take] = self.made[rank[take]]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            take -= np.arange(len(take))
            near = np.concatenate((take, take[take > 0] - 1))
            inner = near + 1 < len(sym)
            inner[inner] = word[near[inner]] == word[near[inner] + 1]
            rank[near[~inner]] = NO_RANK
            near = near[inner]
            rank[near] = self.rank(sym[near], sym[near + 1])
        of = np.concatenate(of)
        return np.concatenate(ids)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(size))

    def step(self, held: bytes, part: bytes, end: bool) -> tuple[list[np.ndarray], bytes]:
        """One more part of a piece: the ids that have become stable, and the bytes still held (less than ``window``)."""
        out, at = [], 0
        while True:
            take = self.window - len(held)
            held, at = held + part[at:at + take], at + take
            if at >= len(part) and end:
                return [*out, *self.merge([held])], b""
            if len(held) < self.window:
                return out, held
            ids = self.merge([held])[0]
            ends = np.cumsum([len(self.token[i]) for i in ids.tolist()])
            stable = len(held) - ends >= self.look[ids]
            n = len(ids) if stable.all() else int(stable.argmin())
            out.append(ids[:n])
            held = held[int(ends[n - 1]) if n else 0:]

    @cached_property
    def early(self) -> Table:
        """Lookahead of the tokens that may leave inside what a kept state can hold, by the hash of their bytes."""
        able = np.flatnonzero((self.length > 0) & (self.length + self.look <= 4 * SHORT))
        key = np.zeros(len(able), np.uint64)
        data, start = np.frombuffer(b"".join(self.token[i] for i in able), np.uint8), np.cumsum(self.length[able]) - self.length[able]
        for k in range(int(self.length[able].max(initial=0))):
            on = np.flatnonzero(self.length[able] > k)
            key[on] = hashed(key[on], data[start[on] + k])
        key, first = np.unique(key, return_index=True)
        out = Table()
        out.put(key.view(np.int64), self.look[able[first]].astype(np.int32))
        return out

    def _forget(self) -> None:
        """Let go of the kept states; only the empty state is left.

        Of a state: the state before it, its last character, how much it holds, where its first token may leave, a hash of its bytes, and, once settled, the
        ids that the end of the piece lets go. ``moves`` leads from state and character to the next state or, complemented, to
        what leaves there and the state of what stays held.
        """
        self.moves, self.kept, self.states = Table(), np.zeros(1 << 12, STATE), 1
        self.kept[0] = (-1, 0, 0, 0, BEYOND, 0, 0, 0)
        self.leaving, self.leavings = np.zeros(1 << 8, LEAVING), 0
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where these ids stand among the kept ones."""
        at, self.used = self.used, self.used + len(ids)
        self.ids = room(self.ids, self.used)
        self.ids[at:self.used] = ids
        return at

    def _held(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that these states hold, one after the other, and their number in each."""
        parent, char, depth, size = (self.kept[k] for k in ("parent", "char", "depth", "size"))
        left = depth[states]
        ends, chars = np.cumsum(left, dtype=np.int64) - 1, np.zeros(int(left.sum(dtype=np.int64)), "<u4")
        at = states
        while len(more := np.flatnonzero(left)):
            at, ends, left = at[more], ends[more], left[more] - 1
            chars[ends] = char[at]
            at, ends = parent[at], ends - 1
        return np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8), size[states].astype(np.int64)

    def _make(self, moves: np.ndarray) -> np.ndarray:
        """New states for these distinct transitions, which lead to them from now on: what is noted in ``moves``."""
        parent, char, states = moves >> CHAR_BITS, moves & ((1 << CHAR_BITS) - 1), np.arange(self.states, self.states + len(moves))
        self.states += len(moves)
        self.kept = room(self.kept, self.states)
        new = self.kept[parent]
        new["parent"], new["char"], new["at"], new["n"] = parent, char, ENDS, 0
        new["depth"] += 1
        width = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        data, start = np.frombuffer(char.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), np.cumsum(width) - width
        for k in range(int(width.max())):
            on = np.flatnonzero(width > k)
            some = new[on]
            some["size"] += 1
            some["hash"] = hashed(some["hash"], data[start[on] + k])
            some["due"] = np.minimum(some["due"], some["size"] + self.early.get(some["hash"].astype(np.int64), BEYOND))
            new[on] = some
        self.kept[states] = new
        self.moves.put(moves, states.astype(np.int32))
        due = np.flatnonzero(new["size"] >= new["due"])  # a first token may have its lookahead
        if len(due):
            self._ready(states[due], moves[due])
            return self.moves.get(moves, NEW)
        return states

    def _ready(self, states: np.ndarray, moves: np.ndarray) -> None:
        """Note the tokens that are stable with what these states hold, if there are any."""
        data, size = self._held(states)
        ids, n = self._merge(data, size)
        kept = self._note(states, ids, n)
        word, ends, first = np.repeat(np.arange(len(states)), n), np.cumsum(self.length[ids]), np.cumsum(n) - n
        late = np.flatnonzero(np.cumsum(size)[word] - ends < self.look[ids])
        stable = n.copy()
        stable[word[late[::-1]]] = late[::-1] - first[word[late[::-1]]]
        cut = np.where(stable > 0, ends[first + stable - 1], 0)
        # a token that ends inside a character leaves with what follows
        go = np.flatnonzero((stable > 0) & ((cut == np.cumsum(size)) | ((np.append(data, 0)[cut] & 0xC0) != 0x80)))
        if not len(go):
            return
        to, more = self.walk([data[lo:hi].tobytes().decode() for lo, hi in zip(cut[go].tolist(), np.cumsum(size)[go].tolist())])
        at, count = self._gather(len(go), [(np.arange(len(go)), kept[go], stable[go]), *more])
        self.leaving = room(self.leaving, self.leavings + len(go))
        noted = np.arange(self.leavings, self.leavings + len(go))
        self.leavings += len(go)
        for k, v in (("at", self._keep(at) + np.cumsum(count) - count), ("n", count), ("to", to)):
            self.leaving[k][noted] = v
        self.moves.put(moves[go], ~noted.astype(np.int32))

    def walk(self, pieces: list[str]) -> tuple[np.ndarray, list[tuple]]:
        """The states at the ends of pieces of at most SHORT characters, and what has left on the way: pieces, where its ids are kept, and how many.

        One character after the other, of all pieces at once; states on the way are made and kept if they are new.
        """
        size = np.fromiter(map(len, pieces), np.uint16, len(pieces))
        chars, left = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4"), []
        order = np.argsort(size, kind="stable")[::-1]
        at, state = (np.cumsum(size, dtype=np.int64) - size)[order], np.zeros(len(pieces), np.int64)
        for k, n in enumerate((len(pieces) - np.cumsum(np.bincount(size))[:-1]).tolist()):
            move = state[:n] << CHAR_BITS | chars[at[:n] + k]
            to = self.moves.get(move, NEW)
            odd = np.flatnonzero(to < 0)
            if len(odd):
                new = odd[to[odd] == NEW]
                if len(new):
                    distinct, back = np.unique(move[new], return_inverse=True)
                    to[new] = self._make(distinct)[back]
                gone = odd[to[odd] < 0]
                if len(gone):
                    let = self.leaving[~to[gone]]
                    left.append((order[gone], let["at"], let["n"]))
                    to[gone] = let["to"]
            state[:n] = to
        out = np.empty_like(state)
        out[order] = state
        return out, left

    def settle(self, states: list[int] | np.ndarray) -> None:
        """What the end of a piece lets go of these states, all merged together."""
        for lo in range(0, len(states), 50_000):
            part = np.asarray(states[lo:lo + 50_000])
            self._note(part, *self._merge(*self._held(part)))

    def _note(self, states: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Keep what the end of a piece lets go of these states; where each one's ids stand."""
        at = self._keep(ids) + np.cumsum(n) - n
        self.kept["at"][states], self.kept["n"][states] = at, n
        return at

    def _end(self, states: np.ndarray) -> tuple:
        """What the ends of pieces let go in these states, as in walk."""
        self.settle(np.unique(states[self.kept["at"][states] == ENDS]))
        ends = self.kept[["at", "n"]][states]
        return np.arange(len(states)), ends["at"], ends["n"]

    def _gather(self, pieces: int, left: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of what has left, piece by piece and in the order given, and their number in each piece."""
        count = np.zeros(pieces, np.int64)
        for piece, _, n in left:
            count[piece] += n
        out, at = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for piece, where, n in left:
            n = n.astype(np.int64)
            out[ranges(at[piece], n)] = self.ids[ranges(where.astype(np.int64), n)]
            at[piece] += n
        return out, count

    def transduce(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most SHORT characters, one piece after the other, and where those of each begin (and the last end)."""
        states, left = self.walk(pieces)
        ids, count = self._gather(len(pieces), [*left, self._end(states)])
        return ids, np.concatenate(([0], np.cumsum(count)))

    def run(self, pieces: list[str], out: list, fresh: dict[int, int]) -> None:
        """As transduce, to see what leaves when: ids to out as bytes, an item for each time that some leave; states whose ends were not settled before to fresh."""
        states, left = self.walk(pieces)
        fresh |= {s: s for s in states[self.kept["at"][states] == ENDS].tolist()}
        each: list[list[bytes]] = [[] for _ in pieces]
        for piece, at, n in [*left, self._end(states)]:
            for k, lo, size in zip(piece.tolist(), at.tolist(), n.tolist(), strict=True):
                each[k].append(self.ids[lo:lo + size].astype("<u4").tobytes())
        out += [x for some in each for x in some]

    def encode_stream(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(index of a text, further ids of it as little-endian unsigned 32-bit integers), chunk by chunk."""
        cutters = [Splitter(self.cut, self.longest) for _ in texts]
        held = [b""] * len(texts)
        live, at = list(range(len(texts))), 0
        while live:
            if self.states > STATES:
                self._forget()
            found, pieces = [], []
            for i in live:
                out: list = []  # ids as bytes, and ranges of pieces
                items = cutters[i].feed(texts[i][at:at + CHUNK], at + CHUNK >= len(texts[i]))
                plain = not cutters[i].odd and max(map(len, items), default=0) <= SHORT
                for short, some in [(True, items)] if plain else groupby(items, is_short):
                    if short:
                        first = len(pieces)
                        pieces += some
                        out.append((first, len(pieces)))
                        continue
                    for p in some:
                        if type(p) is list:
                            out.append(np.array([self.special[p[0]]], "<u4").tobytes())
                            continue
                        ids, held[i] = self.step(b"", p.encode(), True) if type(p) is str else self.step(held[i], p[0].encode(), p[1])
                        out += [x.astype("<u4").tobytes() for x in ids]
                found.append(out)
            ids, begin = self.transduce(pieces)
            ids = ids.astype("<u4", copy=False)
            for i, out in zip(live, found, strict=True):
                yield i, b"".join([x if type(x) is bytes else ids[begin[x[0]]:begin[x[1]]].tobytes() for x in out])
            at += CHUNK
            live = [i for i in live if at < len(texts[i])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, for callers that return them."""
        out: list[list[bytes]] = [[] for _ in texts]
        for i, ids in self.encode_stream(texts):
            out[i].append(ids)
        return [b"".join(x) for x in out]

    def decode_stream(self, machine: codecs.IncrementalDecoder, ids: bytes, end: bool = False) -> str:
        return machine.decode(b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())), end)

    def decode(self, packed: bytes) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        out = [self.decode_stream(machine, packed[lo:lo + 4 * CHUNK]) for lo in range(0, len(packed), 4 * CHUNK)]
        return "".join(out) + machine.decode(b"", True)


_BUILT: dict[str, Transducer] = {}


def transducer(raw: bytes) -> Transducer:
    """One per worker process and vocabulary."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Transducer(raw)
    return _BUILT[key]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def shipped(df: DataFrame, path: str | None):
    """The vocabulary file's bytes as a broadcast: one file of a fixed vocabulary, read on the driver."""
    with open(path or default_path(), "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("vocabulary file above 64 MB")
    return df.sparkSession.sparkContext.broadcast(raw)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every row: token count and digests of ids and decoded text."""
    raw = shipped(df, path)

    def make():
        t = transducer(raw.value)

        def f(_, texts):
            n = [0] * len(texts)
            ids_sha, text_sha = ([hashlib.sha256() for _ in texts] for _ in range(2))
            machines = [codecs.getincrementaldecoder("utf-8")("replace") for _ in texts]
            for i, ids in t.encode_stream([x.decode("utf-8", "replace") for x in texts]):
                n[i] += len(ids) // 4
                ids_sha[i].update(ids)
                text_sha[i].update(t.decode_stream(machines[i], ids).encode())
            for h, m in zip(text_sha, machines, strict=True):
                h.update(m.decode(b"", True).encode())
            return {"n_tokens": n, "ids_sha256": [h.hexdigest() for h in ids_sha], "decoded_sha256": [h.hexdigest() for h in text_sha]}

        return f

    return annotate(df, id_col, text_col, FIELDS, make, SLICE_BYTES)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, out_col: str = "ids") -> DataFrame:
    """The ids of every row as an array column."""
    raw = shipped(df, path)

    def make():
        t = transducer(raw.value)

        def f(_, texts):
            return {out_col: [np.frombuffer(p, "<u4").astype(np.int32) for p in t.encode([x.decode("utf-8", "replace") for x in texts])]}

        return f

    return annotate(df, id_col, text_col, [(out_col, T.ArrayType(T.IntegerType()))], make, SLICE_BYTES)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, out_col: str = "text") -> DataFrame:
    """The text of every row's ids; null ids give an empty text."""
    raw = shipped(df, path)
    df = df.withColumn("__none", F.lit(None).cast("string"))

    def make():
        t = transducer(raw.value)
        return lambda _, texts, ids: {out_col: [t.decode(np.array(x or [], "<u4").tobytes()) for x in ids]}

    return annotate(df, id_col, "__none", [(out_col, T.StringType())], make, extra={"ids": F.col(ids_col)})


def tokens_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, round_trip) for every row: the ids and whether they decode to the text."""
    raw = shipped(df, path)

    def make():
        t = transducer(raw.value)

        def f(_, texts):
            plain = [x.decode("utf-8", "replace") for x in texts]
            packed = t.encode(plain)
            if t.states > STAGE_STATES:  # a reused worker would hold them through the stages of a pipeline
                t._forget()
            return {
                "ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in packed],
                "round_trip": [t.decode(p) == x for p, x in zip(packed, plain, strict=True)],
            }

        return f

    return annotate(df, id_col, text_col, [("ids", T.ArrayType(T.IntegerType())), ("round_trip", T.BooleanType())], make, SLICE_BYTES)
