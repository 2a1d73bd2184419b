"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from mercato.llm import spelling
from mercato.llm.queries_more import op13_spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n: dict[str, int], times: int = 10) -> dict:
    """word -> (form, root, n, number of near words, count of the form)."""
    form, near_words = {}, {}
    for w in n:
        near_words[w] = [b for b in n if near(w, b)]
        best = min(near_words[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near_words[w]), n[form[w]] if form[w] else None)
    return out


def found(rows) -> dict:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.fixture(scope="module")
def counts():
    r = random.Random(4)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(300)}
    words |= {"aaaaaaa", "aaaaaaaa", "x" * 100, "x" * 101, "x" * 99 + "y", "日本語", "日本",
              "𝒳yz", "𝒴yz", "q"}
    return {w: r.choice([1, 2, 3, 30, 300, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("max_bytes", [spelling.MAX_BYTES, 250])
def test_all_pairs(spark, counts, max_bytes):
    """In one pass, and in several because the filters may not hold all words."""
    sizes = Counter(min(len(w), spelling.LONGEST_SHARD) for w in counts)
    assert (spelling.Filters(sizes, max_bytes).passes > 1) == (max_bytes == 250)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(table, max_bytes=max_bytes).collect()) == brute(counts)


def test_long_words_and_odd_rows(spark):
    """Words of thousands of letters, nulls, empty words, repeated rows and a
    column of a clashing name."""
    base = "ab" * 1500
    n = {base: 400, base[1:]: 20, "c" + base[1:]: 1, "zz": 5, "zy": 50}
    rows = [(w, k, "x") for w, k in n.items()] + [(None, 3, None), ("", 4, "y"), ("zz", 0, "z")]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, near string"))
    assert found(got.collect()) == brute(n)
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).collect() == []


def test_query_over_small_documents(spark, tmp_path):
    """The query against plain Python, from texts with nulls and upper case."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdeéÀ") for _ in range(r.randint(6, 9))) for _ in range(25)]
    docs = []
    for i in range(300):
        words = [r.choice(base) for _ in range(r.randint(0, 40))]
        words = [w[:3] + w[4:] if r.random() < .05 else w.upper() if r.random() < .1 else w
                 for w in words]
        docs.append((i, " ".join(words) + r.choice(["", ".", "9", "\n"])))
    docs += [(900, None), (901, ""), (None, base[0] + " " + base[1]), (0, docs[0][1])]
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = op13_spelling(spark, str(tmp_path)).collect()
    assert found(got) == brute({w: k for w, k in count.items() if k >= 2})
    assert any(row["form"] for row in got)
