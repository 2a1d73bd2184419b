"""Rows, texts and neighbours that used to be lost."""

from __future__ import annotations

import json
import random

import corpus_pipeline
import pytest

from mercato.llm import chat, fingerprint
from mercato.llm.queries import REPLY_SCHEMA

DOCS = "doc_id long, text string, lang string, __key string, n_chars long"


def _texts(r, n):
    return [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
                     + str(r.randint(0, 400)) for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("top", [5, (1 << 63) - 1])
def test_near_dedup_keeps_one_row_of_each_text(spark, top):
    a, b, c, d = _texts(random.Random(1), 4)
    rows = [(1, a, "en", "x", 9), (3, b, "de", None, None), (top, b + " end", "en", "y", 1),
            (top, c, "en", "z", 2), (top, c, None, None, None), (7, d, "en", "w", 3),
            (7, d + " tail", "en", "v", 4), (None, a, "en", "u", 5), (None, None, None, None, None),
            (8, "", "en", None, 0), (9, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL").collect()
                 if r["text"])
    seven = [x for x in got if x[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (d, d + " tail")
    group = (3, b) if top == 5 else (top, b + " end")
    assert [x for x in got if x[0] != 7] == sorted([(1, a), group, (top, c)])
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id IN (8, 9)").count() == 2
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").collect() == []


def test_a_call_keeps_its_text_and_arguments(spark):
    rows = [(1, 0, "assistant", "let me look", "c1", "reply", "{not json", None, None),
            (1, 1, "assistant", None, "c2", "reply", '{"prompt": "x", "turn": 1}', None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, "
                               "call_id string, tool string, arguments string, after string, "
                               "result_for string")
    made = {r["turn"]: r for r in chat.formatted(df, REPLY_SCHEMA).collect()}
    first, second = (json.loads(made[i]["json"]) for i in (0, 1))
    assert first["content"] == "let me look"
    assert first["tool_calls"][0]["arguments"] == "{not json" and not made[0]["arguments_ok"]
    assert "content" not in second
    assert second["tool_calls"][0]["arguments"] == {"prompt": "x", "turn": 1}


def test_next_row_of_ids_beyond_doubles(spark):
    big = 1 << 53
    ids = [big + 1, big, big + 3, big + 2, None, 5, -big - 1, -big]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for size in (1000, 2):
        got = {r["text"]: r["next"] for r in fingerprint.with_next(
            df, "doc_id", {"text": "next"}, "text", rows_per_bucket=size).collect()}
        order = [f"t{i}" for i in [None, *sorted(i for i in ids if i is not None)]]
        assert got == dict(zip(order, order[1:] + order[:1], strict=True))
