"""Encodings of any number of levels, and positions by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mercato.operators import encode
from mercato.operators._util import range_index
from mercato.operators.split import key_hash


def test_a_hundred_thousand_levels(spark):
    """Every level has its index and its place in the vector; a third of the
    rows share one level."""
    n = 100_000
    df = spark.range(n).select(F.concat(F.lit("item-"), F.col("id").cast("string")).alias("item"))
    df = df.unionAll(spark.range(n // 2).select(F.lit("item-7").alias("item")))
    levels = encode.level_table(df, ["item"])
    assert encode.level_counts(levels) == {"item": n}
    rows = encode.encode(df, levels, {"item": n})
    got = rows.groupBy("item_index").count()
    assert got.count() == n and got.agg(F.max("item_index")).first()[0] == n - 1
    assert got.orderBy(F.col("count").desc()).first()["count"] == n // 2 + 1
    first = rows.where("item = 'item-7'").first()
    assert first["item_vec"].size == n
    assert list(first["item_vec"].indices) == [int(first["item_index"])]


def test_unknown_and_null_values_are_zeros(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "k string")
    levels = encode.level_table(df, ["k"])
    assert [(r["value"], r["index"], r["rows"]) for r in levels.orderBy("index").collect()] == \
        [("a", 0, 2), ("b", 1, 1)]
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    got = encode.encode(new, levels, {"k": 2}).select("k", vector_to_array("k_vec").alias("v"))
    assert {r["k"]: list(r["v"]) for r in got.collect()} == \
        {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0], None: [0.0, 0.0]}


@pytest.mark.parametrize("rows_per_range", [10, 1_000_000])
def test_positions_of_values_that_share_their_first_characters(spark, rows_per_range):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), f"prefix-{i:05d}" if i else None)
            for i in r.sample(range(700), 600)]
    got = range_index(spark.createDataFrame(rows, "g string, v string").repartition(5), ["v"], ["g"],
                      "place", rows_per_range).collect()
    for g in ("hot", "b", None):
        own = sorted(((x["v"] is not None, x["v"] or "", x["place"]) for x in got if x["g"] == g))
        assert [x[-1] for x in own] == list(range(len(own)))
    assert len(got) == len(rows)


def test_no_range_holds_more_than_its_share(spark):
    df = spark.range(4000).select(F.format_string("same-start-%06d", "id").alias("v"))
    staged = df.repartitionByRange(8, "v").groupBy(F.spark_partition_id()).count()
    assert staged.agg(F.max("count")).first()[0] < 4000 / 8 * 1.6


def test_out_of_fold_means(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None]), float(r.randint(1, 9))) for i in range(300)]
    rows += [(1000, "lone", 5.0), (1001, "empty", None)]
    df = spark.createDataFrame(rows, "id long, item string, q double")
    got = {x["id"]: x for x in encode.with_out_of_fold_means(df, "item", "q", "id").collect()}
    folds = {x["id"]: int(x["h"][:7], 16) % encode.FOLDS
             for x in df.select("id", key_hash("id").alias("h")).collect()}
    known = [x for x in rows if x[2] is not None]
    overall = sum(x[2] for x in known) / len(known)
    for i, item, _ in rows:
        others = [x[2] for x in known if x[1] == item and folds[x[0]] != folds[i]]
        assert got[i]["fold"] == folds[i]
        assert got[i]["item_mean"] == pytest.approx(sum(others) / len(others) if others else overall)
    assert len(got) == len(rows)
    new = spark.createDataFrame([("hot",), ("never",), (None,)], "item string")
    scored = encode.with_item_means(new, encode.item_means(df, "item", "q"),
                                    encode.overall_mean(df, "q"), "item")
    assert {x["item"]: x["item_mean"] for x in scored.collect()}["never"] == pytest.approx(overall)
