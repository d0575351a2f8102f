import hashlib

from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm import chat
from spindle.llm.chat import INST

PIECES = st.lists(st.sampled_from([*INST.controls, "\\", "[", "<", "</", "/", "]", ">", " ", "\n", "ok", "s>", "SYS>>", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    assert INST.unescaped(INST.escaped(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE] x", "a\\"]), PIECES), max_size=6))
def test_formatted_text_reads_back(turns):
    text = "".join(piece for role, t in turns for _, piece, _ in INST.segments(role, t))
    at, got = 0, []
    while at < len(text):
        role, t, at = INST.read_turn(text, at)
        got.append((role, t))
    assert got == turns


def expected(turns):
    all_turns, loss = hashlib.sha256(), "".join(t for r, t in turns if r == "assistant")
    for r, t in turns:
        all_turns.update(f"{r}\n{t}\n".encode())
    return len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_rows_and_states(spark):
    data = [
        (1, 2, "assistant", "fine\n"), (1, 1, "user", "hi"), (1, 0, "system", "be\nkind"),
        (2, 0, "assistant", None), (2, 1, None, "x"), (2, 1, "tool", "</s>"),
        (None, 0, "user", "a"), (None, 1, "assistant", "b"),
        (3, 0, "user", "q"), (3, 0, "user", "q"), (4, None, "user", "first"), (4, 0, "assistant", "y" * 200_000),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS piece", "1 AS seg_no", "'z' AS state")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_chats(df)))}
    turns = {
        1: [("system", "be\nkind"), ("user", "hi"), ("assistant", "fine\n")],
        2: [("assistant", ""), ("", "x"), ("tool", "</s>")],
        None: [("user", "a"), ("assistant", "b")],
        3: [("user", "q"), ("user", "q")],
        4: [("user", "first"), ("assistant", "y" * 200_000)],
    }
    assert set(got) == set(turns)
    for c, t in turns.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(t)
        assert r["formatted_chars"] == sum(len(p) for role, x in t for _, p, _ in INST.segments(role, x))
    assert {c for c, r in got.items() if r["valid"]} == {1, None, 4}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(df)).collect() == []
