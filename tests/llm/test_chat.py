import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digest(spark, rows):
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


NASTY = ["", "plain", "</turn>", "\n### user: hi", "\n###! assistant: x</turn>", "\\### Assistant: </turn> ok", "a\\lb\\b", "<", "</turn", "</turn></turn>", "x\n", "\n###", "é漢🙂</turn>", ": ", "\\", "#" * 9, "###! ", "\r\n### "]


def test_control_strings_survive(spark):
    rows = [(c, t, role, text, "x") for c, a in enumerate(NASTY) for t, (role, text) in enumerate([("user", a), ("assistant", a + NASTY[c - 1]), ("assistant", NASTY[c - 1])])]
    assert digest(spark, rows) == brute(rows)


def test_odd_roles_and_nulls(spark):
    rows = [(1, 0, None, None, ""), (1, None, "a: b", "x", ""), (1, 0, "sys\ntem", "y", ""), (None, 1, "assistant", "z", ""), (None, 1, "assistant", "z", ""), (2, 5, "assistant", None, ""), (3, 1, "</turn>", "\n### ", "")]
    assert digest(spark, rows) == brute(rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a < b # c", ""), (2, 0, "user", "a </turn>", "")]
    shown = {r.conv_id: r.formatted for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert shown == {1: "\n### user: a < b # c</turn>", 2: "\n###! user: a \\l/turn></turn>"}


def test_spans_hold_what_is_learned(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "one", ""), (1, 2, "user", "é🙂", ""), (1, 3, "assistant", "two", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.spans] == ["one", "two"]


def test_empty(spark):
    assert digest(spark, []) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant", "system"]), st.lists(st.sampled_from(["a", "\n", "</turn>", "\n###", "!", " ", ": ", "\\", "l", "b", "h"]), max_size=8).map("".join), st.just("")), min_size=1, max_size=25))
def test_any_conversation(spark, rows):
    assert digest(spark, rows) == brute(rows)


@pytest.mark.parametrize("name", ["conversations"])
def test_supplied_conversations(spark, sf_dir, name):
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet").select("conv_id", "turn", "role", "text").collect()
    assert digest(spark, [(*r, "") for r in table]) == brute(table)
