import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from proofline.llm.chat import format_chat, format_turn, parse, read_chat

PIECES = st.lists(st.sampled_from(["\\", "###", "#", " ", "</turn>", "\n", "a", "### user\n", "é", "n", "\r"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    out = [format_turn(*x) for x in turns]
    back = parse("".join(x[0] for x in out))
    assert [x[:2] for x in back] == turns


def test_plain_text_stays_plain():
    assert format_turn("user", "hi \\ there")[0] == "### user\nhi \\ there\n</turn>\n"


@pytest.mark.parametrize("bad", ["x", "### a", "### a\nb", "### a\nb###c\n</turn>\n", "### a\nb</turn>\n"])
def test_other_texts_are_refused(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_digests(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "é😀"), (None, None, "user", "x" * 50_000), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv: r for r in read_chat(format_chat(df)).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read_chat(format_chat(df.limit(0))).count() == 0
