from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import chat

SIGNS = ["<", "s", ">", "/", "\\", "[", "INST]", "|", "turn", "<|end|>", "</s>", "[INST]", "<<", "SYS", "é", " "]


@given(st.lists(st.sampled_from(SIGNS), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def brute(rows):
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(text for *_, role, text in turns if role == "assistant")
        written = "".join(f"<|turn|>{chat.escape(role)}<|text|>{chat.escape(text)}<|end|>" for *_, role, text in turns)
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        out[conv] = (len(turns), sha256(whole.encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest(), len(written))
    return out


@pytest.mark.parametrize("part_ids", [1, 40, 1 << 16])
def test_reads_back_what_was_written(spark, part_ids):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "<|end|> 日本 👍"), (1, 1, "assistant", "again"), (1, 1, "assistant", "again"),
            (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "no id"), (None, None, "assistant", "first"),
            (3, 0, "tool <|turn|>", "\n\n  x\t"), (3, 5, "assistant", "y" * 5000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} [INST]") for i in range(300)]
    turns = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, ids int, mask string")
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_conversations(turns, part_ids=part_ids)).collect()}
    assert got == brute(rows)


def test_mask_covers_assistant_text_alone(spark):
    turns = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "tell me")], "conv_id long, turn long, role string, text string")
    row, = chat.format_conversations(turns).collect()
    pieces = chat._pieces(None)
    assert b"".join(pieces[i] for i, m in zip(row.ids, row.mask) if m) == b"tell me"
    assert b"".join(pieces[i] for i in row.ids) == b"<|turn|>user<|text|>ask<|end|><|turn|>assistant<|text|>tell me<|end|>"
    assert Counter(row.mask)[1] == len(chat.tokens.encoder(None).encode(["tell me"])[0])


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(turns)).collect() == []
    assert [r.conv_id for r in chat.digests(chat.format_conversations(chat.with_planted(turns))).collect()] == [-1]
