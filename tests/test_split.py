"""The exact stratified split against sorted hashes."""

from __future__ import annotations

import hashlib
import random

from mercato.operators.split import stratified_split


def _hash(key):
    return hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()


def _brute(rows, test, validation):
    classes = {}
    for row in rows:
        classes.setdefault(row[:1] + row[2:3], []).append(row)
    out = []
    for members in classes.values():
        members.sort(key=lambda r: _hash(r[1]))
        n = len(members)
        a, b = (n * test + 50) // 100, (n * (test + validation) + 50) // 100
        out += [(*r, "test" if i < a else "validation" if i < b else "train")
                for i, r in enumerate(members)]
    return sorted(out, key=str)


def test_quotas_of_every_class(spark):
    r = random.Random(3)
    keys = r.sample(range(10**6), 3000)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), k, r.choice([0, 1, None]), "x")
            for k in keys] + [("ten", k, k % 2, "y") for k in range(10)] + [("one", 5, 1, "z")]
    df = spark.createDataFrame(rows, "tenant string, id long, churned int, `__test` string")
    df = df.withColumnRenamed("__test", "note")
    expected = _brute(rows, 20, 10)
    for shape in (df, df.repartition(7, "note")):
        got = stratified_split(shape, "id", "churned", ["tenant"], 20, 10).collect()
        assert sorted((tuple(x) for x in got), key=str) == expected
    assert {x[-1] for x in expected if x[0] == "ten"} == {"test", "validation", "train"}


def test_rows_of_a_key_stay_together(spark):
    rows = [(i % 40, i % 2) for i in range(400)]
    got = stratified_split(spark.createDataFrame(rows, "id long, churned int"), "id", "churned")
    assert got.groupBy("id", "churned").agg({"split": "max"}).count() == \
        got.select("id", "churned", "split").distinct().count()


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, churned int")
    assert stratified_split(none, "id", "churned").collect() == []
