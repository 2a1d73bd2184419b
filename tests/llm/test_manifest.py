"""The manifest against plain hashing."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from mercato.llm import manifest
from mercato.llm.queries_more import op12_manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str]):
    """(top, for each node the levels of (before, after))."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place - place % 8:place - place % 8 + 8]
            ways[i].append((run[:place % 8], run[place % 8 + 1:]))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], ways


def brute(rows):
    """Sorted result rows of (group, key, leaf, probe)."""
    def order(row):
        return (row[1] is not None, row[1] or 0, row[2])

    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([r[2] for r in sorted(groups[g], key=order)]) for g in names}
    root, ways = climb([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, ways, strict=True):
        for (_, key, leaf, probe), way in zip(sorted(groups[g], key=order), trees[g][1],
                                              strict=True):
            node = probe or leaf
            for before, after in way + up:
                node = sha("".join(before) + node + "".join(after))
            proof = sha("".join("".join(b + a) for b, a in way + up))
            out.append((key, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("grp").collect()), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "lang string, id long, h string, p string, slot string")
    return result(manifest.manifest(df, "lang", "id", "h", "p"))


def test_ids_of_all_kinds(spark):
    """Scattered, negative and extreme ids, repeated ids, identical rows,
    null ids and groups, groups of one row and of a whole cell."""
    r = random.Random(1)
    rows = [("en", i, sha(f"a{i}"), None) for i in r.sample(range(100_000), 700)]
    rows += [("de", i, sha(f"b{i}"), sha("no") if i % 5 == 0 else None) for i in range(512)]
    rows += [("fr", i, sha(f"c{i}"), None) for i in range(513)]
    rows += [(None, i, sha(f"d{i}"), None) for i in
             (-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, -64, -65, 1 << 40, 3, None, None)]
    rows += [("one", 5, sha("alone"), sha("alone")), ("", 7, sha("e"), None)]
    rows += [("twin", 9, sha(f"f{i}"), None) for i in range(40)]
    rows += [("twin", 9, sha("same"), sha("other"))] * 30 + [("twin", 10, sha("next"), None)]
    rows += [("twin", None, sha("null"), None)] * 9
    assert run(spark, rows) == brute(rows)


def test_nine_groups_and_one(spark):
    rows = [(f"g{i}", i, sha(str(i)), None) for i in range(9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == [(0, sha("0"), sha("0"), sha("0"), sha(""), sha("0"), True)]
    assert run(spark, []) == []


def test_copies_beyond_a_chunk(spark):
    """Identical rows of more than a chunk and a cell."""
    n = 2 * manifest.COPIES + 5
    df = (spark.range(n).select(F.lit("en").alias("lang"), F.lit(1).cast("long").alias("id"),
                                F.lit(sha("x")).alias("h"), F.lit(None).cast("string").alias("p")))
    got = result(manifest.manifest(df, "lang", "id", "h", "p"))
    assert got == brute([("en", 1, sha("x"), None)] * n)


def test_query_over_odd_documents(spark, tmp_path):
    docs = [(i, f"Text {i}\n", "en" if i % 3 else None, f"s{i % 4}", i) for i in range(60)]
    docs += [(60, None, "de", None, None), (61, "", "de", "é", -5), (None, "No Id", "de", "s", 1),
             (3, "Text 3 again", "en", "s", 2), (62, "Ä É Long " * 5000, "de", "s", 45_000)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(path + "/documents.parquet")

    def leaf(doc_id, text, lang, source, n_chars):
        values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    rows = []
    for doc_id, text, *rest in docs:
        probe = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            probe = leaf(doc_id, text and re.sub("[A-Z]", lambda m: m[0].lower(), text), *rest)
        rows.append((rest[0], doc_id, leaf(doc_id, text, *rest), probe))
    got = result(op12_manifest(spark, path))
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)
