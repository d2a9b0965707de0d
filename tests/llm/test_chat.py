import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import compare
from veilframe.llm import chat, queries

SHARDS = [*chat.CONTROLS, "[\\INST]", "<\\\\s>", "[", "<", "<<", "/", "INST]", "s>", "|role|>", "\\", "]", "user", "", " ", "\n", "é", "x"]
said = st.lists(st.sampled_from(SHARDS), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "system", "assistant", "tool", ""]), said)


def test_query_equals_sql(spark, sf_dir):
    assert compare(spark, queries.queries()["op11_chat_format"], queries.SQL["op11_chat_format"], sf_dir) > 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(roles, said), max_size=6))
def test_round_trip(turns):
    pieces = [chat.render(*turn) for turn in turns]
    assert chat.parse("".join(p for p, *_ in pieces)) == turns
    for (role, text), (piece, start, length, n) in zip(turns, pieces, strict=True):
        assert chat.unescape(piece[start : start + length]) == text
        assert n == sum(chat.escape(part) != part for part in ((text,) if role in chat.MARKS else (role, text)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(roles, said), max_size=5), st.integers(1, 9))
def test_reader_takes_any_portions(turns, step):
    text, reader = "".join(chat.render(*turn)[0] for turn in turns), chat.Reader()
    found = [turn for i in range(0, len(text), step) for turn in reader.feed(text[i : i + step])]
    reader.close()
    assert found == turns


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a</s>", "<s>a<s>b</s>", "[/INST]", "<|role|>a</s>b<|end|>", "<", "<s>a</s>b"])
def test_what_is_no_conversation(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def brute(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        found.setdefault(conv, []).append((turn is not None, turn or 0, chat.render(role, text)[0], role, text))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), digest(learned), sum(len(p) for _, _, p, *_ in turns))
    return out


def test_edges_and_a_hot_conversation(spark):
    r = random.Random(5)
    texts = [None, "", "</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>>x<</SYS>>", "é" * 50_000, "<s>" * 3000, "plain"]
    rows = [(None if i % 9 == 0 else i % 7 if i % 3 else 5, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "[INST]", None]), r.choice(texts)) for i in range(600)]
    rows += rows[:40]
    df = spark.createDataFrame([(*row, "a", 1) for row in rows], "conv_id long, turn long, role string, text string, piece string, n_escaped int")
    formatted = chat.format_turns(df)
    assert formatted.columns == [*df.columns, "piece_", "loss_start", "loss_length", "n_escaped_", "source_digest"]
    got = {x.conv_id: tuple(x)[1:6] for x in chat.read_back(formatted, chat.turn_columns(df)).collect()}
    assert got == brute(rows)
    empty = chat.format_turns(df.limit(0))
    assert chat.read_back(empty, chat.turn_columns(df)).count() == 0
