import os

from pyspark.sql import functions as F

from mercato.sources import sinks, uploads
from mercato.streaming import ingest


def test_replace_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "batch_id long, v string")
    sinks.replace_partitions(a, path, ["batch_id"])
    sinks.replace_partitions(a.where("batch_id = 2"), path, ["batch_id"])   # retried batch 2
    got = sorted((r["batch_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "x"), (2, "y")]


def test_batch_handler_replay_does_not_duplicate(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(7, 1.0), (7, 2.0), (8, 3.0)], "upload_id long, quantity double")
    handle = ingest.make_batch_handler(
        out, lambda b: b.groupBy("upload_id").agg(F.sum("quantity").alias("q")))
    handle(batch, 0)
    handle(batch, 0)          # the same micro-batch replayed after a failure
    handle(batch.where("upload_id = 8"), 1)
    res = spark.read.parquet(os.path.join(out, "analyses"))
    assert sorted((r["batch_id"], r["upload_id"], r["q"]) for r in res.collect()) == [
        (0, 7, 3.0), (0, 8, 3.0), (1, 8, 3.0)]
    runs = spark.read.parquet(os.path.join(out, "pipeline_runs"))
    assert runs.where("batch_id = 0").count() == 4      # started + completed per upload


def test_new_rows_only_rejects_and_defaults(spark):
    existing = spark.createDataFrame([(1, "a")], "tenant_id long, customer_id string")
    incoming = spark.createDataFrame(
        [(1, "a", "Gold", None), (1, "b", "Gold", 5), (1, "b", "Gold", 5), (2, "a", None, 1),
         (2, None, "Free", 1)],
        "tenant_id long, customer_id string, segment string, total_orders int")
    ok, bad = sinks.new_rows_only(existing, incoming, ["tenant_id", "customer_id"],
                                  required=["customer_id", "segment"],
                                  defaults={"total_orders": 0, "total_spent": 0.0})
    assert [(r["tenant_id"], r["customer_id"], r["total_orders"], r["total_spent"])
            for r in ok.collect()] == [(1, "b", 5, 0.0)]
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["already exists", "duplicate key in batch",
                       "missing required field: customer_id",
                       "missing required field: segment"]


def test_export_csv_round_trip(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([(1, dt.datetime(2024, 3, 5, 10, 0), 2.5)],
                               "id long, order_date timestamp, price double")
    path = str(tmp_path / "exp")
    sinks.export_csv(df, path, date_cols=["order_date"])
    back = uploads.read_uploads(spark, path).first()
    assert (back["id"], back["order_date"], back["price"]) == (1, "2024-03-05", 2.5)


def test_analyses_rows_json(spark):
    doc = spark.createDataFrame([(1, (3, "x"))], "upload_id long, summary struct<rows:long,s:string>")
    r = sinks.analyses_rows(doc).first()
    assert r["summary_json"] == '{"rows":3,"s":"x"}' and r["created_at"] is not None


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    from mercato.operators._util import salted_join
    rows = spark.range(0, 20000, numPartitions=8).withColumn(
        "k", F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id") % 7))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(rows, stats, ["k"], buckets=8)
    assert joined.count() == 20000
    assert joined.where("n IS NULL").count() == 0
    hot_n = rows.where("k = 0").count()
    hot = joined.where("k = 0").select("n").distinct().collect()
    assert [r["n"] for r in hot] == [hot_n]     # every salt copy carries the same statistics
    left = salted_join(rows, stats.where("k <> 3"), ["k"], buckets=4, how="left")
    assert left.count() == 20000 and left.where("n IS NULL").count() == rows.where("k = 3").count()


def test_duplicate_keys_of_a_batch_are_rejected_not_lost(spark):
    known = spark.createDataFrame([("k",)], "id string")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("k", 5), (None, 3)],
                                "id string, v long")
    accepted, rejected = sinks.new_rows_only(known, new, ["id"], ["id"])
    assert [tuple(r) for r in accepted.collect()] == [("a", 1)]
    assert sorted((r["id"] or "", r["v"], r["reason"]) for r in rejected.collect()) == [
        ("", 3, "missing required field: id"), ("a", 1, "duplicate key in batch"),
        ("a", 2, "duplicate key in batch"), ("k", 5, "already exists")]


def test_uploads_bind_columns_by_their_own_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text('sku,quantity,price\nA,1,2.5\n"say ""hi"" now",2,3.5\n')
    (tmp_path / "two.csv").write_text('price,extra,sku,quantity\n99.5,x,"line\nbreak",7\n')
    rows = uploads.read_uploads(spark, str(tmp_path)).orderBy("quantity").collect()
    assert [(r["sku"], r["quantity"], r["price"], r["extra"]) for r in rows] == [
        ("A", 1, 2.5, None), ('say "hi" now', 2, 3.5, None), ("line\nbreak", 7, 99.5, "x")]


def test_types_of_one_upload_do_not_change_another(spark):
    df = spark.createDataFrame([("u1", "7"), ("u1", "8"), ("u2", "x"), ("u2", "9"), (None, "4")],
                               "upload_id string, code string")
    kinds = {(r["upload_id"], r["kind"]) for r in uploads.upload_types(df, ["code"]).collect()}
    assert kinds == {("u1", "long"), ("u2", "string"), (None, "long")}
    got = sorted(((r["upload_id"] or ""), r["code"], r["code_number"])
                 for r in uploads.with_upload_numbers(df, ["code"]).collect())
    assert got == [("", "4", 4.0), ("u1", "7", 7.0), ("u1", "8", 8.0), ("u2", "9", None),
                   ("u2", "x", None)]


def test_one_bad_upload_does_not_block_its_batch(spark, tmp_path):
    out = str(tmp_path / "o")

    def analyse(batch):
        checked = batch.withColumn("q", F.when(F.col("q") < 0, F.raise_error(F.lit("negative q")))
                                   .otherwise(F.col("q")))
        return checked.groupBy("upload_id").agg(F.sum("q").alias("q"))

    batch = spark.createDataFrame([(1, 5), (1, 6), (2, -1), (3, 7)], "upload_id long, q long")
    handle = ingest.make_batch_handler(out, analyse)
    for _ in range(2):                                  # the second run is a replay
        handle(batch, 4)
        res = spark.read.parquet(os.path.join(out, "analyses"))
        assert sorted((r["upload_id"], r["q"]) for r in res.collect()) == [(1, 11), (3, 7)]
        runs = spark.read.parquet(os.path.join(out, "pipeline_runs"))
        got = {(r["upload_id"], r["seq"]): (r["status"], r["message"]) for r in runs.collect()}
        assert runs.count() == len(got) == 6
        assert {got[u, 0][0] for u in (1, 2, 3)} == {"started"}
        assert got[1, 1] == ("completed", "analysis of 2 rows completed")
        assert got[2, 1][0] == "failed" and "negative q" in got[2, 1][1]
        assert got[3, 1][0] == "completed"
