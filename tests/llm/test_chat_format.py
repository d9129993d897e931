import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.chat_format import NotInGrammar, Reader, _full, digest_conversations, format_turns, parse, render_turn, unescape

PART = st.sampled_from(["\\", "###", "### ", ": ", "</turn>", "</turn>\n", "\n", "a", "user", "Assistant", "<", ":", "é", " "])
TEXT = st.lists(PART, max_size=8).map("".join) | st.text(max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]) | TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    parts = [render_turn(*t) for t in turns]
    read = list(parse("".join(p[0] for p in parts)))
    assert [r[:2] for r in read] == turns
    assert all(unescape(text[a:b]) == t[1] for (text, a, b), t in zip(parts, turns))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]) | TEXT, TEXT), max_size=4), st.lists(st.integers(1, 9), min_size=1, max_size=5))
def test_reader_finds_the_turns_wherever_the_text_is_cut(turns, sizes):
    whole = "".join(render_turn(*t)[0] for t in turns)
    reader, got, at, k = Reader(), [], 0, 0
    while at < len(whole):
        reader.take(whole[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
        got += [(role, body, unescape(whole[a:b])) for role, body, a, b in reader.turns()]
    reader.close()
    assert [g[:2] for g in got] == turns and all(g[1] == g[2] for g in got)


def test_what_is_no_turn_is_an_error():
    reader = Reader()
    reader.take("### User: a")
    assert list(reader.turns()) == []
    with pytest.raises(NotInGrammar):
        reader.close()


def test_full_escape_is_in_the_grammar():
    assert list(parse(_full("a: b", "x</turn>\n")[0]))[0][:2] == ("a: b", "x</turn>\n")


def test_plain_text_is_not_escaped():
    assert render_turn("user", "plain ### text: yes") == ("### User: plain ### text: yes</turn>\n", 10, 29)


def conversation(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    tricky = r"\### Assistant: </turn> ok" + "</turn>\n### User: "
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", tricky), (2, None, None, None), (None, 5, "user", "z"), (None, 2, "assistant", "a" * 100_000), (3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (3, 1, "user", "tie")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss_start int").repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in digest_conversations(format_turns(df)).collect()}
    want = {
        1: [("user", "hi"), ("assistant", tricky)],
        2: [("", "")],
        None: [("assistant", "a" * 100_000), ("user", "z")],
        3: [("assistant", "tie"), ("user", "tie"), ("user", "tie")],
    }
    assert got == {k: conversation(v) for k, v in want.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digest_conversations(format_turns(df)).count() == 0
