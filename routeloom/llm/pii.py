"""Operator 1: personal data by base patterns and a skip-chain conditional random field.

Base spans follow the contract's patterns (leftmost, non-overlapping within a kind, failing matches
dropped without retry), in time linear in the text. The field then labels *candidate tokens*: runs
of non-space characters that hold a digit or ``@``, and later mentions of the local part of an
address found in the same document. All other words can only be "other", so the chain falls apart
between candidates without loss.

Model: label set other/email/ip/card/phone. Unary potentials come from shape and context features,
chain potentials join candidates that stand side by side, and skip potentials join consecutive
mentions of repeated or similar tokens (same digits, same last seven digits, same address or its
local part) however far apart. Inference is loopy sum-product with damping over the whole document;
labels that a token cannot have (a card without a valid checksum, an address part above 255) are
excluded beforehand. Marginals of at least ``threshold`` add spans; base spans always stay.

Training takes base spans as positives and candidates that can be nothing else as negatives. The
other candidates are *unlabelled*: the base misses some of them (a number that runs into the next
one fails as a whole), so they only count as negatives with weight WEAK, and no edge to them is
learnt from. Weights are fitted by pseudo-likelihood, where each mention's own label is hidden and
its neighbours' and distant repeats' labels are the evidence, on a bounded sample: ``sample_docs``
documents with candidates are expected in it, chosen by hash of id and text (equal rows count once),
and of each at most ``sample_nodes`` consecutive candidates, from a hashed offset.

Edge cases: a null or empty text has no spans (digest of the empty string). Repeated rows get the
same spans each. Without a single candidate in the table nothing is learnt and nothing is added.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm.common import annotate, as_bytes, same_schema

KINDS = ["email", "ip", "card", "phone"]
RANK = {k: i for i, k in enumerate(KINDS)}
LABELS = len(KINDS) + 1
DIM = 1 << 12
SAMPLE_DOCS = 4000
SAMPLE_NODES = 400
WEAK = 0.03  # weight of an unlabelled candidate as a negative
THRESHOLD = 0.9
SKIP_PRIOR = 4.0  # weight decay pulls the skip potentials towards agreement
ROUNDS = 12
DAMPING = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
HANDLE = re.compile(r"[A-Za-z0-9._%+@-]")
AFTER_HANDLE = re.compile(r"[A-Za-z0-9_%+@-]|\.[A-Za-z0-9]")
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}

FIELDS = [
    *[(f"n_{k}", T.LongType()) for k in KINDS],
    ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType()),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    at, end = text.find("@"), 0
    floor = 0
    while at >= 0:
        left = text[max(floor, end):at]
        start = max(floor, end) + len(left.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end, "email"))
        floor = at + 1
        at = text.find("@", max(floor, end))
    if DIGIT.search(text):
        for run in DOTTED.finditer(text):
            if run.group().count(".") < 3:
                continue
            parts, pos, k = run.group().split("."), run.start(), 0
            while k + 3 < len(parts):
                four = parts[k:k + 4]
                if all(four):
                    size = sum(map(len, four)) + 3
                    if all(map(octet, four)):
                        out.append((pos, pos + size, "ip"))
                    pos += size + 1
                    k += 4
                else:
                    pos += len(parts[k]) + 1
                    k += 1
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", token)
    return re.sub(r"[^\W\d_]+", "a", s)[:40]


def allowed(token: str, core: str) -> int:
    """Bit mask of the labels a token may have."""
    mask = 1
    if "@" in token:
        mask |= 2
    groups = token.split(".")
    if len(groups) == 4 and all(g.isascii() and g.isdigit() and octet(g) for g in groups):
        mask |= 4
    plain = re.fullmatch(r"[0-9 ().+/-]+", token)
    if plain and 12 <= len(core) <= 19 and luhn(core):
        mask |= 8
    if plain and 1 <= len(core) <= 15:
        mask |= 16
    return mask


def mentions(text: str, handles: set[str]) -> Iterator[tuple[int, int, str]]:
    """Where handles (lower case) stand by themselves, in any case: one pass over the text for all of them."""
    if not handles:
        return
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(LOWER_ASCII)
    found = ahocorasick.Automaton()
    for h in handles:
        found.add_word(h, h)
    found.make_automaton()
    for last, h in found.iter(low):
        s, e = last + 1 - len(h), last + 1
        if (s == 0 or not HANDLE.match(text[s - 1])) and not AFTER_HANDLE.match(text, e):
            yield s, e, h


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, str]]:
    """(start, end, core, mask, kind by base or "") in text order."""
    found: dict[tuple[int, int], tuple[str, int]] = {}
    handles = set()
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in ".,;:!?\"'>]}":
            e -= 1
        while e > s and text[s] in "\"'<[{":
            s += 1
        if e > s and (DIGIT.search(text, s, e) or "@" in text[s:e]):
            token = text[s:e]
            core = token.lower() if "@" in token else NOT_DIGIT.sub("", token)
            found[s, e] = core, allowed(token, core)
            if "@" in token:
                local = token.lower().partition("@")[0]
                if len(local) >= 5 and re.search(r"[0-9._]", local):
                    handles.add(local)
    for s, e, local in mentions(text, handles):
        found[s, e] = local, 3
    out = []
    for (s, e), (core, mask) in sorted(found.items()):
        kind = next((k for a, b, k in base if a < e and s < b), "")
        if kind:
            mask |= 1 << (RANK[kind] + 1)
        out.append((s, e, core, mask, kind))
    return out


def graph(text: str, nodes: list[tuple[int, int, str, int, str]]) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Hashed features of each node and edges (u, v, 0 chain or 1 skip)."""
    feats, edges, last = [], [], {}
    for i, (s, e, core, _, _) in enumerate(nodes):
        token = text[s:e]
        before = text[max(0, s - 40):s].split()
        after = text[e:e + 40].split()
        own = [
            f"s{shape(token)}", f"d{min(sum(c.isdigit() for c in token), 20)}", f"a{'@' in token}", f"p{token[0]}",
            f"b{before[-1][-12:].lower() if before else ''}", f"bs{shape(before[-1]) if before else ''}", f"as{shape(after[0]) if after else ''}", "1",
        ]
        feats.append([zlib.crc32(x.encode()) % DIM for x in own])
        if i and text[nodes[i - 1][1]:s].strip() == "" and s - nodes[i - 1][1] <= 2:
            edges.append((i - 1, i, 0))
        tail = f"~{core[-7:]}" if "@" not in core and core.isdigit() and len(core) >= 7 else core
        for key in {core, core.partition("@")[0], tail}:
            if len(key) >= 4:
                if key in last and last[key] != i:
                    edges.append((last[key], i, 1))
                last[key] = i
    return feats, edges


def fit(rows: list[tuple[list[list[int]], list[tuple[int, int, int]], list[int]]], steps: int = 60) -> dict[str, np.ndarray]:
    """Pseudo-likelihood by Adagrad; rows are (features, edges, labels) of documents, label -1 is unlabelled."""
    feats, y, pairs = [], [], []
    for f, e, labels in rows:
        pairs += [(u + len(y), v + len(y), t) for u, v, t in e if labels[u] >= 0 and labels[v] >= 0]
        feats += f
        y += labels
    prior = np.stack((np.zeros((LABELS, LABELS)), SKIP_PRIOR * np.eye(LABELS)))
    model = {"w": np.zeros((DIM, LABELS)), "edge": prior.copy()}
    if not y:
        return model
    x, y = np.array(feats), np.array(y)
    weight = np.where(y < 0, WEAK, 1.0)
    y, n = np.maximum(y, 0), weight.sum()
    u, v, t = np.array(pairs, np.int64).reshape(-1, 3).T
    sums = {k: np.full_like(m, 1e-6) for k, m in model.items()}
    hot = np.eye(LABELS)[y]
    for _ in range(steps):
        z = model["w"][x].sum(1)
        np.add.at(z, v, model["edge"][t, y[u]])
        np.add.at(z, u, model["edge"][t, :, y[v]])
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        g = (q - hot) * weight[:, None] / n
        grad = {"w": np.stack([np.bincount(x.ravel(), np.repeat(g[:, k], x.shape[1]), DIM) for k in range(LABELS)], 1) + 1e-6 * model["w"], "edge": np.zeros_like(model["edge"])}
        np.add.at(grad["edge"], (t, y[u]), g[v])
        np.add.at(grad["edge"].transpose(0, 2, 1), (t, y[v]), g[u])
        grad["edge"] += 1e-3 * (model["edge"] - prior)
        for k in model:
            sums[k] += grad[k] ** 2
            model[k] = model[k] - 0.5 * grad[k] / np.sqrt(sums[k])
    return model


def marginals(model: dict[str, np.ndarray], feats: list[list[int]], masks: list[int], edges: list[tuple[int, int, int]]) -> np.ndarray:
    """Loopy sum-product in log space, all messages of a round at once."""
    unary = model["w"][np.array(feats)].sum(1)
    legal = (np.array(masks)[:, None] >> np.arange(LABELS)) & 1
    unary = np.where(legal, unary, -1e9)
    belief = unary
    if edges:
        p = np.array(edges, np.int64)
        src, dst = np.concatenate((p[:, 0], p[:, 1])), np.concatenate((p[:, 1], p[:, 0]))
        m = len(p)
        pot = np.concatenate((model["edge"][p[:, 2]], model["edge"][p[:, 2]].transpose(0, 2, 1)))
        back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
        msg = np.zeros((2 * m, LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            cavity = belief[src] - msg[back]
            z = cavity[:, :, None] + pot
            top = z.max(1, keepdims=True)
            new = (np.log(np.exp(z - top).sum(1)) + top[:, 0])
            new -= new.max(1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, dst, msg)
    belief = belief - belief.max(1, keepdims=True)
    q = np.exp(belief)
    return q / q.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, str]], model: dict[str, np.ndarray], threshold: float) -> list[tuple[int, int, str]]:
    nodes = candidates(text, base)
    if not nodes:
        return []
    free = [i for i, x in enumerate(nodes) if x[3] != 1 and not x[4]]
    if not free:
        return []
    feats, edges = graph(text, nodes)
    # the base decides its own tokens; they are evidence for the others
    q = marginals(model, feats, [1 << (RANK[x[4]] + 1) if x[4] else x[3] for x in nodes], edges)
    chain = {v for _, v, t in edges if t == 0}
    out: list[tuple[int, int, str]] = []
    last, total = -1, 0
    for i in free:
        k = int(q[i].argmax())
        if k and q[i, k] >= threshold:
            s, e, kind = nodes[i][0], nodes[i][1], KINDS[k - 1]
            digits = len(NOT_DIGIT.sub("", text[s:e]))
            if out and i == last + 1 and i in chain and out[-1][2] == kind == "phone":
                out[-1] = (out[-1][0], e, kind)
                total += digits
            else:
                if out and out[-1][2] == "phone" and total < 7:
                    out.pop()
                out.append((s, e, kind))
                total = digits
            last = i
    if out and out[-1][2] == "phone" and total < 7:
        out.pop()
    return out


def training_row(text: str, offset: int, sample_nodes: int) -> tuple | None:
    """(features, edges, labels) of at most sample_nodes consecutive candidates of a document."""
    nodes = candidates(text, base_spans(text)) if DIGIT.search(text) or "@" in text else []
    if not nodes:
        return None
    at = offset % max(1, len(nodes) - sample_nodes + 1)
    nodes = nodes[at:at + sample_nodes]
    feats, edges = graph(text, nodes)
    return feats, edges, [RANK[x[4]] + 1 if x[4] else (0 if x[3] == 1 else -1) for x in nodes]


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_nodes: int = SAMPLE_NODES) -> dict[str, np.ndarray]:
    """Fit on a sample of about sample_docs documents with candidates, chosen by a hash of id and text."""

    def make():
        def f(_, texts, marks):
            rows = [training_row(t.decode("utf-8", "replace"), h, sample_nodes) for t, h in zip(texts, marks, strict=True)]
            return {"row": [r and json.dumps(r) for r in rows], "h": marks}

        return f

    some = df.where(F.col(text_col).rlike("[0-9@]"))
    mark = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(2**62 - 1))
    below = int(min(1.0, sample_docs / max(1, some.count())) * 2**62)
    some = some.where(mark < below) if below < 2**62 else some
    rows = annotate(some, id_col, text_col, [("row", T.StringType()), ("h", T.LongType())], make, extra={"mark": mark})
    got = rows.where("row is not null").select("h", "row").dropDuplicates(["h"]).collect()
    return fit([json.loads(r["row"]) for r in sorted(got)])


def find_all(text: str, model: dict[str, np.ndarray], threshold: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    return base, added_spans(text, base, model, threshold) if base or DIGIT.search(text) or "@" in text else []


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1])))


def find_pii(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict[str, np.ndarray] | None = None,
    threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """Span list and base digest for every row. The model (a fixed-size table) travels in the closure."""
    model = learn(df, id_col, text_col, sample_docs) if model is None else model

    def make():
        def f(_, texts):
            out: dict[str, list] = {n: [] for n, _ in FIELDS}
            for t in texts:
                base, more = find_all(t.decode("utf-8", "replace"), model, threshold)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
                out["n_added"].append(len(more))
            return out

        return f

    return annotate(df, id_col, text_col, FIELDS, make)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind in angle brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in sorted(spans, key=lambda x: (x[0], RANK[x[2]])):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"<{k.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def mask_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """All columns of the input; text with its personal data masked, and the character count kept in step."""
    model = learn(df, id_col, text_col, sample_docs)
    at = df.columns.index(text_col)
    count = df.columns.index(chars_col) if chars_col in df.columns else None

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, changed, sizes = [], False, []
            for raw, null in zip(as_bytes(b.column(at)), b.column(at).is_null().to_pylist(), strict=True):
                text = raw.decode("utf-8", "replace")
                base, more = find_all(text, model, threshold)
                if base or more:
                    text, changed = masked(text, base + more), True
                texts.append(None if null else text)
                sizes.append(len(text))
            if not changed:
                return b
            cols = list(b.columns)
            old = cols[at]
            new = pa.array(texts, type=old.type)
            cols[at] = new
            if count is not None and pa.types.is_integer(cols[count].type):
                cols[count] = pa.array([o if x == y else n for o, n, x, y in zip(cols[count].to_pylist(), sizes, old.to_pylist(), texts, strict=True)], type=cols[count].type)
            return pa.RecordBatch.from_arrays(cols, schema=b.schema)

        return f

    return same_schema(df, make)
