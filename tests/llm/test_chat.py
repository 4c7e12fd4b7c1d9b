"""Chat formatting: exact round trips and loss masks."""

from __future__ import annotations

import random

from depotcast.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, turns string, example int, formatted string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def round_trip(spark, rows):
    examples = chat.expand(talks(spark, rows)).cache()
    return examples.collect(), {r.conv_id: r for r in chat.read_back(examples).collect()}


def test_marks_inside_texts_come_back(spark):
    rng = random.Random(4)
    parts = [*chat.MARKS, "\\", "\\\\", " ", "<", "[", "s>", "INST]", "é", "\n", "x", "$1", ""]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", "<s>", "[ROLE]"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))))
    examples, back = round_trip(spark, rows)
    for conv in range(120):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].replies == [t for role, t in own if role == "assistant"]
    for e in examples:
        own = [(r[2], r[3]) for r in rows if r[0] == e.conv_id]
        if e.loss_start is not None:
            under = e.formatted[e.loss_start : e.loss_start + e.loss_length]
            assert e.formatted[e.loss_start + e.loss_length :] == " </s>"  # nothing after the reply
            assert (e.loss_length == 0) == (under == "")
        else:
            assert e.whole and own[-1][0] != "assistant"


def test_every_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "assistant", "d"), (2, 0, "assistant", None), (3, 0, None, None)]
    examples, back = round_trip(spark, rows)
    got = {(e.conv_id, e.example): e for e in examples}
    assert len(got) == 4
    assert got[1, 0].formatted == "<s>[INST] a [/INST] b </s>" and not got[1, 0].whole
    assert got[1, 1].formatted == "<s>[INST] a [/INST] b </s><s>[INST] c [/INST] d </s>" and got[1, 1].whole
    assert (got[2, 0].formatted, got[2, 0].loss_start, got[2, 0].loss_length) == ("  </s>", 1, 0)
    assert (got[3, 0].formatted, got[3, 0].loss_start) == ("[ROLE]  [/ROLE]  </s>", None)
    assert [(t.role, t.text) for t in back[3].turns] == [("", "")] and back[1].formatted_chars == sum(len(got[1, i].formatted) for i in (0, 1))


def test_ties_repeats_nulls_and_no_rows(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "z"), (7, 0, "user", "x"), (7, 0, "user", "x")]
    _, back = round_trip(spark, rows)
    assert [t.text for t in back[None].turns] == ["z", "a", "b"] and [t.text for t in back[7].turns] == ["x", "x"]
    assert chat.read_back(chat.expand(talks(spark, rows).limit(0))).collect() == []


def test_long_texts(spark):
    text = "</s> \\[INST] " * 20000
    _, back = round_trip(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])
    assert back[1].replies == [text] and back[1].turns[0].text == text


def test_the_control_conversation_is_there(spark, small):
    (row,) = registry.op5_chat_format(spark, small).where("conv_id = -1").collect()
    assert (row.n_turns, row.loss_chars) == (2, len(registry.CONTROL_TEXT))
