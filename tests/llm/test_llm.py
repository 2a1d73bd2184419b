"""The text operators against brute-force versions and on edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mercato.llm import (bpe, chat, decontaminate, extraction, fingerprint, licences, neardup,
                         quality, sharding, toxicity)
from mercato.llm.components import components
from mercato.llm.queries import QUERIES, REPLY_SCHEMA, rank_codec

DOCS = "doc_id long, text string, source string, `__score` double"


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd_docs(spark, words):
    """Nulls in every column, empty and long texts, repeats, clashing names."""
    r = random.Random(6)
    long = " ".join(r.choice(words) for _ in range(20_000))
    rows = [(1, "", "a", 0.1), (2, None, None, None), (None, "no id at all", "b", 1.0),
            (3, long, "a", 0.2), (4, long, "b", None), (5, "tie", "a", 0.0), (5, "tie", "a", 0.0),
            (6, "x " * 50, "a", 0.0), (7, "  \t\n", "c", 0.0), (8, "tie", None, 0.0)]
    return spark.createDataFrame(rows, DOCS)


def _encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_bpe_matches_the_library(spark, odd_docs):
    own = _encoding()
    extra = spark.createDataFrame([(20 + i, t, None, None) for i, t in enumerate(
        ["a" * 3000, "日本語 текст \x1c\x85　 mixed  spaces ", "é̂'s 123abc !!?", "\x00\x01"])],
        DOCS)
    rows = bpe.encoded(odd_docs.union(extra), rank_codec(spark)).collect()
    assert len(rows) == odd_docs.count() + 4
    for row in rows:
        text = row["text"] or ""
        assert row["ids"] == own.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_merge_piece_is_leftmost_lowest():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"aaa": 301, b"ab": 299}
    assert bpe.merge_piece(b"aaaa", ranks) == [300, 300]
    assert bpe.merge_piece(b"aab", ranks) == [97, 299]
    assert bpe.merge_piece(b"", ranks) == []


def _sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, words, k):
    r = random.Random(k)
    texts = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "one", "One", "two words"]
    rows = list(enumerate(texts, 10))
    got = {x.doc_id: x for x in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()}
    sets = {i: _sets(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and either and 100 * both >= 80 * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in sets:
        assert got[i].n_shingles == len(sets[i])
        assert got[i].component_id == find(i), i
        assert got[i].kept == (find(i) == i)


def test_near_duplicates_on_odd_rows(spark, odd_docs):
    rows = neardup.near_duplicates(odd_docs, words=2).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].component_id == 3 and not by[4].kept and by[8].component_id == 5
    assert by[1].n_shingles == 0 and by[2].n_shingles == 0 and by[None].component_id is None
    empty = neardup.near_duplicates(odd_docs.limit(0))
    assert empty.count() == 0


def test_copies_far_from_the_centre_still_link(spark, words):
    """A chain of texts, each like the next only: one component."""
    r = random.Random(9)
    text = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(text)))
        at = i * 10
        text = text[:at] + [r.choice(words) for _ in range(7)] + text[at + 7:]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert {x.component_id for x in got.collect()} == {0}


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 40), (31, 30)]
    got = {x.node: x.root for x in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 30: 30, 31: 30}


def test_decontamination_finds_exact_and_near_windows(spark, words):
    r = random.Random(11)
    item = [r.choice(words) for _ in range(70)]
    near = list(item)
    near[35] = "changed"
    far = [w if i % 5 else "other" for i, w in enumerate(item)]
    pad = [r.choice(words) for _ in range(300)]
    docs = [(1, " ".join(pad[:90] + item + pad[90:])), (2, " ".join(near).upper()),
            (3, " ".join(pad)), (4, " ".join(pad[:5] + far)), (5, None), (6, ""),
            (None, " ".join(item)), (1, " ".join(pad[:90] + item + pad[90:]))]
    marks = [(7, " ".join(item)), (8, "few words"), (9, None), (None, "")]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(marks, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x for x in found}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and len(found) == 3
    assert got[1, 7].similarity == 1.0 and got[1, 7].word_start == 90
    assert got[2, 7].similarity == pytest.approx(61 / 71)
    none = decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"),
                                      spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0


def test_multi_index_masks_cover_the_radius():
    masks = set(decontaminate._near_masks())
    r = random.Random(3)
    for _ in range(300):
        x = sum(1 << b for b in r.sample(range(64), r.randint(0, decontaminate.RADIUS)))
        blocks = [x >> i * 16 & 0xFFFF for i in range(4)]
        assert any(b in masks for b in blocks)


def test_shards_are_even_and_keep_groups(spark, odd_docs):
    rows = [(i, f"t{i // 3}" if i < 60 else ("hot" if i < 160 else f"s{i}")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"same": F.md5(F.col("text").cast("binary")), "spread": F.xxhash64("doc_id")})
    out = sharding.balanced_shards(docs, "same", "spread").collect()
    counts, homes = {}, {}
    for x in out:
        counts.setdefault(x["shard"], []).append(x["slot"])
        homes.setdefault(x["text"], set()).add(x["shard"])
    assert len(out) == 300 and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sum(len(homes[f"t{i}"]) == 1 for i in range(20)) >= 17
    assert len(homes["hot"]) <= 5          # 100 rows over shards of 37 or 38
    odd = odd_docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("same"),
                          F.xxhash64("doc_id").alias("spread"))
    assert sharding.balanced_shards(odd, "same", "spread").count() == odd.count()
    assert sharding.balanced_shards(odd.limit(0), "same", "spread").count() == 0


def test_fingerprints(spark, odd_docs):
    r = random.Random(2)
    base = "".join(r.choice("abcdefghij klm") for _ in range(5000))
    rows = [(1, base), (2, base[:2000] + "CHANGED" + base[2000:]), (3, base[::-1]), (4, base),
            (5, "a" * 50_000), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "f", fingerprint.fingerprint("text"))
    f = {x.doc_id: x.f for x in df.collect()}
    assert f[1] == f[4] and f[6] == "1::" and len(f[5]) < 200
    pairs = spark.createDataFrame([(f[1], f[i]) for i in (2, 3, 4)], "a string, b string")
    near, far, same = [x[0] for x in pairs.select(fingerprint.likeness("a", "b")).collect()]
    assert near > 0.85 and far < 0.35 and same == 1.0
    following = fingerprint.with_next(odd_docs.select("doc_id", "text"), "doc_id",
                                      {"doc_id": "next"}, "text", rows_per_bucket=2).collect()
    order = sorted(x.doc_id for x in following if x.doc_id is not None)
    assert len(following) == odd_docs.count()
    nexts = {x.doc_id: x.next for x in following}
    assert nexts[None] == 1 and nexts[8] is None and nexts[1] == 2 and order[0] == 1
    empty = fingerprint.with_next(odd_docs.limit(0), "doc_id", {"text": "next"}, "text")
    assert empty.count() == 0


def test_extraction_of_templates_and_lone_pages(spark):
    r = random.Random(8)

    def page(i, main="article"):
        body = "".join(f"<p>Word{i} &amp; more   text {r.random()}<br>line</p>" for _ in range(4))
        return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>"
                f"<nav><ul><li><a href='/x'>Menu {i}</a></li></ul></nav><!-- c --><div class='ad'>buy"
                f"</div><{main}><h1>Title {i}</h1>{body}<script>var t='</p>';</script>"
                f"<div class=\"comments\"><p>first!</p></div></{main}><footer>&copy; x</footer></body>")

    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(8)]
    rows += [(20, "http://lone.example/", page(20)), (21, None, None), (22, "http://e.example/", ""),
             (23, "not a url", "plain &lt;text&gt;"), (24, "http://one.example/8", "<p>cut <b>off"),
             (25, "http://two.example/1", page(25, "div id=content").replace("</div id=content>", "</div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "__host", F.lit("mine"))
    got = {x.page_id: x for x in extraction.extracted(df).collect()}
    assert len(got) == len(rows) and got[0]["__host"] == "mine"
    for i in (*range(8), 20, 25):
        blocks = got[i].text.split("\n\n")
        assert blocks[0] == f"Title {i}" and len(blocks) == 5, got[i].text
        assert all(re.fullmatch(rf"Word{i} & more text 0\.\d+(e-\d+)? line", b) for b in blocks[1:])
    assert got[21].text == "" and got[22].text == "" and got[23].text == "plain <text>"
    assert got[24].text == "cut off"
    assert extraction.extracted(df.limit(0)).count() == 0


def test_licences_are_found_and_inherited(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", "no statement here at all"),
            ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
            ("a/b/c/y", "text"), ("z/q", "long text of its own\nLicensed under CC BY-NC 4.0.\n" + "w " * 500),
            ("z/r", None), (None, "All rights reserved."), (None, ""), ("top", "")]
    got = {(x.path, x.text): x for x in licences.scanned(
        spark.createDataFrame(rows, "path string, text string")).collect()}
    by = {p: got[p, t] for p, t in rows if p}
    assert by["a/b/x"].licence == "MIT" and by["a/b/x"].found == "inherited"
    assert by["a/b/c/y"].licence == "Apache-2.0" and by["a/b/c/y"].from_path == "a/b/c/LICENSE"
    assert by["z/q"].licence == "CC-BY-NC-4.0" and by["z/q"].found == "statement"
    assert by["z/r"].licence is None and by["top"].licence is None
    assert got[None, "All rights reserved."].licence == "LicenseRef-All-Rights-Reserved"


def test_chat_links_orders_and_validates(spark):
    schema = ("conv_id long, turn long, role string, text string, call_id string, tool string, "
              "arguments string, after string, result_for string")
    ask = '{"turn": 1, "prompt": "p"}'
    rows = [(1, 3, "tool", "late", None, None, None, None, "a"),
            (1, 1, "assistant", None, "a", "reply", ask, None, None),
            (1, 5, "assistant", None, "b", "reply", '{"prompt": 4, "turn": 2}', "a", None),
            (1, 6, "tool", "again", None, None, None, None, "a"),
            (1, 7, "assistant", None, "a", "reply", "not json", None, None),
            (1, 8, "tool", "lost", None, None, None, None, "nowhere"),
            (2, 1, "assistant", None, "c", "reply", ask, "d", None),
            (2, 2, "assistant", None, "d", "reply", ask, "c", None),
            (None, None, None, None, None, None, None, None, None)]
    rows.append(rows[0])
    got = chat.formatted(spark.createDataFrame(rows, schema), REPLY_SCHEMA).collect()
    assert len(got) == 9
    by = {(x.conv_id, x.turn): x for x in got}
    assert by[1, 1].status == "linked" and by[1, 1].arguments_ok and by[1, 1].level == 0
    assert by[1, 3].level == 1 and by[1, 5].level == 2 and by[1, 5].arguments_ok is False
    assert by[1, 5].status == "open" and by[1, 6].status == "repeated_result"
    assert by[1, 7].status == "repeated_call" and by[1, 7].arguments_ok is False
    assert by[1, 8].status == "orphan_result" and by[2, 1].status == "cycle"
    assert by[1, 1].position < by[1, 3].position < by[1, 5].position
    assert '"arguments":{"prompt":"p","turn":1}' in by[1, 1].json


@pytest.mark.parametrize("name, module, label", [("quality", quality, "quality"),
                                                 ("toxicity", toxicity, "toxic")])
def test_scores_of_odd_rows_and_without_labels(spark, odd_docs, name, module, label):
    score = getattr(module, f"{name}_scores")
    for labels in ([], [(i, 1) for i in range(9)]):
        frame = spark.createDataFrame(labels, f"doc_id long, {label} int")
        out = score(odd_docs, frame, out="score").collect()
        assert len(out) == odd_docs.count() and all(0 <= x.score <= 1 for x in out)
        assert out[0]["__score"] is None or 0 <= out[0]["__score"] <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    for name, label, least in (("op8_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.85)):
        out = QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out")
        right = out.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert right >= least, name


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    own = _encoding()
    kept = [x.doc_id for x in out]
    assert len(set(kept)) == len(kept) and 0 < len(kept) < docs.count()
    for x in out:
        assert x.ids == own.encode_ordinary(x.text) and x.exact and x.n_tokens == len(x.ids)
    items = [" ".join(re.findall(r"[^\W_]+", x.text.lower()))
             for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for x in out:
        plain = " ".join(re.findall(r"[^\W_]+", x.text.lower()))
        assert not any(i in plain for i in items)


def test_edited_text_of_the_fingerprint_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((x.doc_id, x.text or "") for x in
                  spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {x.doc_id: x for x in QUERIES["op10_fingerprints"](spark, sf).collect()}
    for k, (i, text) in enumerate(docs):
        m, after = len(text) // 4, docs[(k + 1) % len(docs)][1]
        edited = text[:len(text) - m] + after[:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
