"""Chat formatting against a plain reading of the contract, and its grammar on hostile texts."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import chat_format as c
from routeloom.llm import queries

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "\\", " ", "<", "|", "x", "é", "\n", "user", "assistant"]
said = st.lists(st.sampled_from(BITS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), said), said), max_size=5))
def test_grammar_reads_back(turns):
    text, at, got = "".join(c.render_turn(*t) for t in turns), 0, []
    while at < len(text):
        role, words, start, end, at = c.parse_turn(text, at)
        got.append((role, words))
        assert c.unescape(text[start:end]) == words
    assert got == turns


def test_plain_texts_stay_bare():
    assert c.render_turn("user", "a [b] <c> \\ d") == "[INST] a [b] <c> \\ d [/INST]"
    assert c.render_turn("user", "x [/INST]") == "[INST] x \\[/INST] [/INST]"
    assert c.parse_turn("[INST] never ends", 0) is None and c.parse_turn(" a [INST] b </s>", 0) is None and c.parse_turn("?", 0) is None


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s> \\[INST]"), (1, None, "system", "first"), (1, 1, "assistant", "same turn"), (2, 0, None, None), (2, 1, "tool<|", "|> x"),
    (3, 5, "user", ""), (3, 5, "user", ""), (None, 0, "assistant", "no id"), (4, -2, "assistant", None), (4, 9, "critic", "é\n" * 5000), (4, 3, "user", "</s>"), (4, 4, "user", "<s>"),
]


@pytest.mark.parametrize("part_chars", [1, 50, 1 << 20])
def test_conversations(spark, tmp_path, part_chars):
    df = spark.createDataFrame([(*r, "other", 1) for r in ROWS], "conv_id long, turn long, role string, text string, segment string, part long")
    parts = c.format_conversations(df, part_chars)
    parts.repartition(5).write.parquet(f"{tmp_path}/parts")
    for source, in_order in ((parts, True), (spark.read.parquet(f"{tmp_path}/parts"), False)):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.read_back(source, in_order).collect()}
        assert got == brute(ROWS)
    masked = sorted((r.conv_id or -1, c.unescape(r.text[s.start : s.end])) for r in parts.collect() for s in r.loss)
    assert masked == sorted((x[0] or -1, x[3] or "") for x in ROWS if x[2] == "assistant")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.read_back(c.format_conversations(df)).count() == 0


def test_query_has_the_hostile_conversation(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.SQL["op11_chat_format"])
    columns = [d[0] for d in want.description]
    got = {tuple(r) for r in queries.QUERIES["op11_chat_format"](spark, sf).select(columns).collect()}
    assert got == set(want.fetchall())
    assert next(r for r in got if r[0] == -7)[columns.index("n_turns")] == 2
