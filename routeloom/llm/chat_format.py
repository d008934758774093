"""Chat formatting by a grammar round trip.

A conversation is rendered as ``<s>`` and its turns, each framed by its role:

    user       [INST] text [/INST]
    assistant  (space)text </s>
    system     <<SYS>> text <</SYS>>
    others     <| role |> text </s>

Control strings are what frames consist of. The deterministic parser (``parse_turn``) tells a turn
by its first character, ends a text at its frame's closing string and takes any other bare control
string inside as a syntax error. A control string behind backslashes is content; the parser takes one
of them away. So each turn is rendered bare first and read again; what does not come back identical
(a control string inside, or one that already stands behind a backslash) is escaped, and the turn is
read again until it is identical. A turn's frame marks its own end, so turns that come back alone come
back in a row, and rendering needs no shuffle: one exchange by conversation follows, and texts are put
together in parts of bounded size, so that neither a cell nor a task holds a whole long conversation.

Edge cases: a null role or text is empty; a null turn comes first; turns with one number stand by
role, then by rendered text, repeated rows included; a null conversation id is a conversation of its
own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER, NAMED, OTHER_END = "<| ", " |> ", " </s>"
CONTROL = re.compile(r"(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\||\|>)")
PART_CHARS = 1 << 20
PARTS = "conv_id {kind}, part long, text string, n_turns long, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def frame(role: str, text: str, head: str | None = None) -> str:
    """A turn as it stands; head: the role's rendering, where it is not a known one."""
    opening, closing = FRAMES.get(role) or (f"{OTHER}{role if head is None else head}{NAMED}", OTHER_END)
    return f"{opening}{text}{closing}"


def until(text: str, start: int, closing: str) -> int | None:
    """Where the content from start ends; None if it does not, or another bare control string comes first."""
    for m in CONTROL.finditer(text, start):
        if not m[1]:
            end = m.start() - 1
            return end if end >= start and text.startswith(closing, end) else None
    return None


def parse_turn(text: str, at: int) -> tuple[str, str, int, int, int] | None:
    """The turn that begins at a place: role, text, where its content starts and ends, where the turn ends; None: no turn."""
    for role, (opening, closing) in FRAMES.items():
        if text.startswith(opening, at):
            start = at + len(opening)
            break
    else:
        if not text.startswith(OTHER, at) or (named := until(text, at + len(OTHER), NAMED)) is None:
            return None
        role, start, closing = unescape(text[at + len(OTHER) : named]), named + len(NAMED), OTHER_END
        if role in FRAMES:
            return None
    end = until(text, start, closing)
    return None if end is None else (role, unescape(text[start:end]), start, end, end + len(closing))


def render_turn(role: str, text: str) -> str:
    """The plainest rendering that the parser reads back as this very turn."""
    plain = frame(role, text)
    tries = [plain] if CONTROL.search(role) is None and CONTROL.search(text) is None else [plain, frame(role, escape(text)), frame(role, text, escape(role)), frame(role, escape(text), escape(role))]
    for said in tries:
        read = parse_turn(said, 0)
        if read is not None and read[:2] == (role, text) and read[4] == len(said):
            return said
    raise ValueError(f"no rendering of this turn reads back: {role[:80]!r}, {text[:80]!r}")


def check_sum(role: str, text: str, before: int = 0) -> int:
    return zlib.crc32(f"{len(role)}:{role}{text}".encode(), before)


def render_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment, source_sum (a check sum of what was rendered), one row for each row of (conv_id, turn, role, text)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            segments = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            sums = [check_sum(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(segments, pa.string()), pa.array(sums, pa.int64())], names=["conv_id", "turn", "role", "segment", "source_sum"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select("conv_id", "turn", empty("role"), empty("text")).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, segment string, source_sum long")


def format_conversations(df: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations: conv_id, part (from 0), text, n_turns, loss (spans of assistant texts as they stand, code points from the part's start).

    A part ends with a turn; it is longer than part_chars by at most one turn. Parts of a conversation
    are rows of one task, in order. Every conversation is read again here and held against its source.
    """
    kind = dict(df.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, said, size, source = None, 0, [], 0, []

        def row() -> tuple:
            whole = "".join(said)
            at, spans, turns = len(BEGIN) if part == 0 else 0, [], 0
            while at < len(whole):
                read = parse_turn(whole, at)
                if read is None or check_sum(*read[:2]) != source[turns]:
                    raise ValueError(f"conversation {key} does not read back from its rendering")
                if read[0] == "assistant":
                    spans.append({"start": read[2], "end": read[3]})
                at, turns = read[4], turns + 1
            if turns != len(source):
                raise ValueError(f"conversation {key} reads back as {turns} turns of {len(source)}")
            return key, part, whole, turns, spans

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "part", "text", "n_turns", "loss"])

        types, begun = None, False
        for b in batches:
            types = types or [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            rows, held = [], 0
            for k, segment, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or k != key:
                    if begun:
                        rows.append(row())
                    key, part, said, size, source, begun = k, 0, [BEGIN], 0, [], True
                elif size >= part_chars:
                    rows.append(row())
                    part, said, size, source = part + 1, [], 0, []
                said.append(segment)
                source.append(s)
                size += len(segment)
                held += len(segment)
                if held >= part_chars and rows:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        if begun:
            yield batch([row()])

    turns = render_turns(df).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "segment")
    return turns.select("conv_id", "segment", "source_sum").mapInArrow(run, PARTS.format(kind=kind))


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; one row a conversation.

    in_order: the parts of a conversation already are consecutive rows of one task, as
    format_conversations leaves them; those of a stored table are sorted first. Digests run along
    the parts, nothing else is kept.
    """
    kind = dict(parts.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, arrow, state = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

        def row() -> tuple:
            k, n, turns, chars, loss, total = state
            return k, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for b in batches:
            arrow = arrow or [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = []
            for k, part, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part == 0:
                    if state is not None:
                        rows.append(row())
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = len(BEGIN) if part == 0 else 0
                while at < len(text):
                    role, said, _, _, at = parse_turn(text, at)
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    masked = unescape(text[s["start"] : s["end"]])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([row()])

    source = parts if in_order else parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return source.select("conv_id", "part", "text", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


__all__ = ["escape", "format_conversations", "parse_turn", "read_back", "render_turn", "render_turns", "unescape"]
