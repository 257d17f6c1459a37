import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", " ", "\n", "a", "<", "[", "</", " [/INST]", "\n<</SYS>>\n"]), max_size=12)
ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "[TEXT] \\", "a [TEXT] b"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLES, PIECES.map("".join)), max_size=5))
def test_round_trip(turns):
    written = [chat.render_turn(r, t) for r, t in turns]
    whole, at = "".join(w[0] for w in written), 0
    for (role, text), (segment, start, stop) in zip(turns, written):
        back, said, s, e, after = chat.parse_turn(whole, at)
        assert (back, said, s - at, e - at, after - at) == (role, text, start, stop, len(segment))
        at = after
    parser = chat.Parser()
    assert [t for i in range(0, len(whole), 3) for t in parser.feed(whole[i : i + 3])] == turns and not parser.rest


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a [OUT] b")[0] == "<s>[INST] a [OUT] b [/INST]"
    assert "\\" in chat.render_turn("user", "a [/INST] b")[0]


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        chat.parse_turn("hello")
    with pytest.raises(chat.Incomplete):
        chat.parse_turn("<s>[INST] hello")


def expected(turns):
    spoken = "".join(t or "" for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(),
        len(spoken), hashlib.sha256(spoken.encode()).hexdigest(),
    )


def test_conversations(spark):
    bad = "</s>[INST] ok [/INST]"
    source = {
        1: [("user", bad), ("assistant", bad)],
        2: [("system", None), ("user", "é" * 40_000), ("assistant", "😀"), (None, "x")],
        None: [("assistant", "")],
        3: [("user", str(i)) for i in range(5000)],  # most rows in one conversation
    }
    rows = [(k, i, r, t, "extra") for k, turns in source.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(7)
    got = {r[0]: tuple(r)[1:5] for r in chat.read_conversations(chat.format_turns(df)).collect()}
    assert got == {k: expected(t) for k, t in source.items()}


def test_ties_repeats_and_no_rows(spark):
    kind = "conv_id string, turn long, role string, text string"
    df = spark.createDataFrame([("a", 1, "user", "y"), ("a", 1, "user", "x"), ("a", 1, "user", "x"), ("a", None, "user", "z")], kind)
    segments = chat.format_turns(df)
    assert chat.read_conversations(segments).first()[1:3] == (4, expected([("user", c) for c in "zxxy"])[1])
    assert chat.read_conversations(segments.where("false")).count() == 0


def test_loss_span(spark):
    df = spark.createDataFrame([("assistant", "a</s>b"), ("user", "u")], "role string, text string")
    for r in chat.format_turns(df).collect():
        if r["role"] == "user":
            assert r["loss_start"] is None
        else:
            assert chat._unescape(r["segment"][r["loss_start"] : r["loss_end"]]) == "a</s>b"


def test_loss_text_is_what_the_mask_covers(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b é"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "`my conv` int, turn long, role string, text string")
    segments = chat.format_turns(df)
    good = chat.read_conversations(segments, "my conv").first()
    assert good["my conv"] == 1 and tuple(good)[1:5] == expected([r[2:] for r in rows])
    shifted = segments.withColumns({"loss_start": segments["loss_start"] + 1, "loss_end": segments["loss_end"] + 1})
    wrong = chat.read_conversations(shifted, "my conv").first()
    assert wrong["turns_sha256"] == good["turns_sha256"] and wrong["loss_sha256"] != good["loss_sha256"]
    wide = segments.withColumn("loss_start", segments["loss_start"] * 0)
    assert chat.read_conversations(wide, "my conv").first()["loss_chars"] > good["loss_chars"]
