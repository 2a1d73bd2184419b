"""Identifiers that recur in several conversations."""

from __future__ import annotations

from mercato.llm import chat
from mercato.llm.queries import REPLY_SCHEMA


def test_equal_identifiers_of_two_conversations_are_two_calls(spark):
    schema = ("conv_id long, turn long, role string, text string, call_id string, tool string, "
              "arguments string, after string, result_for string")
    ask = '{"turn": 1, "prompt": "p"}'
    rows = []
    for conv in (1, 2, None):
        rows += [(conv, 1, "assistant", None, "call_1", "reply", ask, None, None),
                 (conv, 2, "tool", f"of {conv}", None, None, None, None, "call_1"),
                 (conv, 3, "assistant", None, "call_2", "reply", ask, "call_1", None)]
    rows += [(3, 1, "tool", "lost", None, None, None, None, "call_1"),
             (3, 2, "assistant", None, "call_2", "reply", ask, "call_1", None)]
    got = chat.formatted(spark.createDataFrame(rows, schema), REPLY_SCHEMA).collect()
    assert len(got) == len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    for conv in (1, 2, None):
        assert [by[conv, t].status for t in (1, 2, 3)] == ["linked", "linked", "open"]
        assert [by[conv, t].level for t in (1, 2, 3)] == [0, 1, 2]
    assert by[3, 1].status == "orphan_result" and by[3, 2].level == 0
