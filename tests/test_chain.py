"""The chain over streamed uploads, and documents read back by path."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mercato.operators import evaluate, runs
from mercato.sources import records, sinks
from mercato.streaming import chain


def _predict(inputs):
    return inputs.withColumn("predicted", F.col("quantity").try_cast("double") * 2)


def test_every_upload_has_its_own_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = "".join(f"s{i},{i},2024-01-{i + 1:02d}\n" for i in range(12))
    (src / "good.csv").write_text("sku,quantity,order_date\n" + good)
    (src / "plain.csv").write_text("a,b\nx,y\n")
    (src / "day.csv").write_text("order_date,quantity,sku\nsoon,1,a\n2024-01-01,2,b\n")
    (src / "wide.csv").write_text("sku,quantity,order_date\na,1,2024-01-01,more\n")
    out = str(tmp_path / "out")
    name = F.regexp_extract("upload_file", "([a-z]+)[.]csv$", 1)
    for _ in range(2):                       # the second run finds nothing new
        chain.run_chain(records.line_stream(spark, str(src)), out, str(tmp_path / "ckpt"),
                        _predict, name).awaitTermination()
    rows = spark.read.parquet(os.path.join(out, "pipeline_runs")).orderBy("upload_id", "seq").collect()
    found = {}
    for r in rows:
        found.setdefault(r["upload_id"], []).append((r["seq"], r["status"]))
    assert found == {
        "good": [(0, "started"), (1, "preprocessing_completed"), (2, "prediction_completed"),
                 (3, "completed")],
        "plain": [(0, "started"), (1, "preprocessing_completed"), (3, "completed")],
        "day": [(0, "started"), (1, "preprocessing_completed"), (2, "prediction_failed"),
                (3, "completed")],
        "wide": [(0, "started"), (3, "failed")]}
    made = spark.read.parquet(os.path.join(out, "predictions"))
    assert {(r["row"], r["predicted"]) for r in made.collect()} == {(i, 2.0 * i) for i in range(12)}
    documents = spark.read.parquet(os.path.join(out, "documents"))
    last = sinks.latest_documents(documents, {"records": "$.record_count:long",
                                              "day": "$.date_column:string"})
    assert {r["upload_id"]: (r["records"], r["day"]) for r in last.collect()} == {
        "good": (12, "order_date"), "plain": (1, None), "day": (2, "order_date")}
    assert "record_count" in sinks.document_schema(documents)


def test_percent_and_padded_ids(spark):
    df = spark.createDataFrame([(17, 80), (1, 3), (0, 0), (5, 5)], "part long, whole long")
    got = [r[0] for r in df.select(runs.percent("part", "whole")).collect()]
    assert got == ["21.3%", "33.3%", "0.0%", "100.0%"]
    ids = [r[0] for r in spark.createDataFrame([(7,), (12345678,)], "i long")
           .select(runs.padded_id("i", "R", 5)).collect()]
    assert ids == ["R00007", "R12345678"]


def test_class_report_by_group(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.1, 0), ("a", 0.2, 1), ("a", 0.3, 0), (None, 0.9, 1)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {(r["g"], r["class"]): (r["precision"], r["recall"], r["support"])
           for r in evaluate.class_report(df, "score", "label", 0.5, ["g"]).collect()}
    assert got["a", "1"] == (0.5, 0.5, 2) and got["a", "0"] == (2 / 3, 2 / 3, 3)
    assert got["a", "macro avg"][0] == (0.5 + 2 / 3) / 2
    assert got[None, "1"] == (1.0, 1.0, 1) and got[None, "weighted avg"] == (1.0, 1.0, 1)
