"""Queries that round-trip through files, the stream and the sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import anomaly, demand, runs
from mercato.session import scratch_path
from mercato.sources import records, sinks, uploads
from mercato.sources.tables import Tables
from mercato.streaming import chain


def _as_files(df, upload: str, order: list[str], path: str) -> None:
    """One CSV file for each value of ``upload``, its rows in ``order``."""
    (df.repartition(upload).sortWithinPartitions(upload, *order)
     .write.partitionBy(upload).option("header", True).option("escape", '"').csv(path))


def _as_parts(df, upload: str, order: list[str], path: str, **options) -> None:
    """CSV files in a folder for each value of ``upload``, whose rows follow
    one another in ``order`` from file to file, written by as many tasks as
    the rows need."""
    (df.repartitionByRange(upload, *order).sortWithinPartitions(upload, *order)
     .drop(*options.pop("without", ())).write.partitionBy(upload)
     .options(header=True, **options).csv(path))


def _upload_of(name: str):
    return F.regexp_extract("upload_file", f"/{name}=([^/]+)/", 1)


@register("outlier_rows", sql="""
WITH l AS (
  SELECT l_returnflag AS upload, l_partkey AS sku, l_extendedprice AS price,
         row_number() OVER (PARTITION BY l_returnflag
                             ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS row
  FROM lineitem),
s AS (SELECT upload, sku, avg(price) AS m, stddev_samp(price) AS sd FROM l
      GROUP BY upload, sku HAVING count(*) >= 5)
SELECT l.upload, l.row, l.sku, l.price
FROM l JOIN s ON l.upload = s.upload AND l.sku = s.sku
WHERE price > m + 2 * sd OR price < m - 2 * sd""")
def q_outlier_rows(spark, sf_dir):
    """Line items as CSV uploads, each of as many files as its rows need;
    every price outlier with the row of the upload that it is in."""
    li = Tables(spark, sf_dir).lineitem.select(
        F.col("l_returnflag").alias("upload"), "l_orderkey", "l_linenumber",
        F.col("l_partkey").alias("sku"), F.col("l_extendedprice").alias("price"))
    path = scratch_path(spark, "outlier-files")
    _as_parts(li, "upload", ["l_orderkey", "l_linenumber", "sku", "price"], path, escape='"')
    cells = records.cells(records.file_lines(spark, path)).withColumn("upload", _upload_of("upload"))
    rows = records.with_row_numbers(cells, upload="upload")
    rows = rows.select("upload", "row",
                       F.col("cells")["sku"].try_cast("long").alias("sku"),
                       F.col("cells")["price"].try_cast("double").alias("price"))
    out = anomaly.item_price_outliers(rows, "sku", "price", "row", ["upload"], k=2.0)
    return out.select("upload", "row", "sku", "price")


@register("upload_manifest", sql="""
SELECT o_orderstatus AS upload, 'text/csv' AS mime_type, 'uploaded' AS status,
       7::BIGINT AS tenant_id, 1::BIGINT AS files, true AS sized
FROM orders GROUP BY o_orderstatus""")
def q_upload_manifest(spark, sf_dir):
    """The manifest of a folder with three CSV uploads and other files."""
    o = Tables(spark, sf_dir).orders
    path = scratch_path(spark, "manifest-files")
    _as_files(o, "o_orderstatus", ["o_orderkey"], path)
    o.groupBy("o_orderstatus").count().write.json(path + "/other")
    listed = uploads.ingest_manifest(spark, path + "/*", tenant_id=7)
    return listed.groupBy(F.regexp_extract("file_path", "/o_orderstatus=([^/]+)/", 1).alias("upload"),
                          "mime_type", "status", "tenant_id").agg(
        F.countDistinct("upload_id").alias("files"),
        F.bool_and((F.col("file_size") > 0) & F.endswith("filename", F.lit(".csv"))).alias("sized"))


@register("tenant_replaced", sql="""
SELECT c_nationkey AS tenant_id, count(*) AS customers,
       CAST(sum(CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END * CAST(c_acctbal AS DECIMAL(18,2)))
            AS DOUBLE) AS balance
FROM customer WHERE c_nationkey <> 3 OR c_mktsegment <> 'BUILDING' GROUP BY c_nationkey""")
def q_tenant_replaced(spark, sf_dir):
    """The customers of all tenants, stored by tenant; one tenant's are
    replaced by a new upload of its own, which reads that tenant only."""
    c = Tables(spark, sf_dir).customer.withColumnRenamed("c_nationkey", "tenant_id")
    path = scratch_path(spark, "tenants")
    sinks.replace_partitions(c, path, ["tenant_id"])
    own = spark.read.parquet(path).where("tenant_id = 3 AND c_mktsegment <> 'BUILDING'")
    new = own.withColumn("c_acctbal", F.col("c_acctbal") * 2)
    staged = scratch_path(spark, "tenant-upload")
    new.write.parquet(staged)
    sinks.replace_partitions(spark.read.parquet(staged), path, ["tenant_id"])
    return spark.read.parquet(path).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@register("analysis_documents", sql="""
SELECT o_orderstatus AS upload_id, count(*) AS records, max(o_totalprice) AS highest,
       arg_min(o_orderpriority, o_orderkey) AS first_priority, NULL::BIGINT AS absent,
       2::BIGINT AS versions
FROM orders GROUP BY o_orderstatus""")
def q_analysis_documents(spark, sf_dir):
    """Analyses written twice as typed documents (the later ones with more
    fields); the latest of each upload read back with fields by path."""
    o = Tables(spark, sf_dir).orders
    first = o.groupBy(F.col("o_orderstatus").alias("upload_id")).agg(
        F.count(F.lit(1)).alias("record_count"))
    second = o.groupBy(F.col("o_orderstatus").alias("upload_id")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.struct(F.max("o_totalprice").alias("highest"),
                 F.array(F.min_by("o_orderpriority", "o_orderkey")).alias("priorities")).alias("prices"))
    path = scratch_path(spark, "documents")
    for i, analysis in enumerate((first, second)):
        sinks.append_table(sinks.document_rows(analysis).withColumn("run", F.lit(i)), path)
    stored = spark.read.parquet(path)
    last = sinks.latest_documents(stored, {
        "records": "$.record_count:long", "highest": "$.prices.highest:double",
        "first_priority": "$.prices.priorities[0]:string", "absent": "$.none:long"}, tie_col="run")
    versions = stored.groupBy("upload_id").agg(F.count(F.lit(1)).alias("versions"))
    return last.join(versions, "upload_id")


@register("run_messages", sql="""
WITH r AS (SELECT user_id, event_type FROM events),
u AS (SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS done,
             count(*) FILTER (event_type = 'error') AS failed
       FROM r GROUP BY user_id)
SELECT 'UP-' || lpad(user_id::VARCHAR, 8, '0') AS upload, runs, failed,
       done || ' of ' || runs || ' runs done (' || tenths // 10 || '.' || tenths % 10 || '%)' AS message
FROM (SELECT *, (2000 * done + runs) // (2 * runs) AS tenths FROM u) WHERE done > 0""")
def q_run_messages(spark, sf_dir):
    """One message for each upload with a successful run: padded id, counts
    and the share of successful runs in percent, with one decimal."""
    ev = Tables(spark, sf_dir).events
    log = ev.select("user_id", F.when(F.col("event_type") == "purchase", "completed")
                    .when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
                    .alias("status"))
    counts = log.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"))
    shown = counts.join(runs.of_status(log, "completed").select("user_id").distinct(), "user_id",
                        "left_semi")
    return shown.select(runs.padded_id("user_id", "UP-", 8).alias("upload"), "runs", "failed",
                        F.concat_ws(" ", F.col("done").cast("string"), F.lit("of"),
                                    F.col("runs").cast("string"), F.lit("runs done"),
                                    F.concat(F.lit("("), runs.percent("done", "runs"), F.lit(")")))
                        .alias("message"))


@register("pipeline_run_chain", sql="""
WITH l AS (
  SELECT o_orderstatus AS upload, l_quantity AS quantity, o_orderdate AS day, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT upload, count(*) AS rows FROM l GROUP BY upload),
f AS (SELECT l_orderkey, l_linenumber FROM l WHERE upload = 'O'
      ORDER BY l_orderkey, l_linenumber LIMIT 1),
d AS (SELECT upload, day, sum(quantity) AS total FROM l
      WHERE upload <> 'O' OR (l_orderkey, l_linenumber) NOT IN (SELECT * FROM f)
      GROUP BY upload, day),
s AS (SELECT upload, avg(total) AS m, stddev_samp(total) AS sd FROM d GROUP BY upload),
a AS (SELECT d.upload, count(*) FILTER (abs(total - m) > 2 * sd) AS odd
      FROM d JOIN s ON d.upload = s.upload GROUP BY d.upload)
SELECT n.upload, seq::INTEGER AS seq, status, message FROM n JOIN a ON n.upload = a.upload,
LATERAL (VALUES
  (0, 'started', rows || ' rows arrived'),
  (1, CASE WHEN n.upload <> 'P' THEN 'preprocessing_completed' END,
      'records: ' || rows || ', anomalies: ' || odd),
  (2, CASE n.upload WHEN 'F' THEN 'prediction_completed' WHEN 'O' THEN 'prediction_failed' END,
      CASE n.upload WHEN 'F' THEN rows || ' predictions' ELSE '1 order dates can''t be read' END),
  (3, CASE WHEN n.upload <> 'P' THEN 'completed' ELSE 'failed' END,
      CASE WHEN n.upload <> 'P' THEN 'all steps done'
           ELSE rows || ' rows have more fields than the header' END)) v(seq, status, message)
WHERE status IS NOT NULL""")
def q_pipeline_run_chain(spark, sf_dir):
    """Line items as three streamed uploads: one runs through, one has an
    order date that is none, one has rows with more fields than its header.
    The run rows of each, in order."""
    t = Tables(spark, sf_dir)
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("upload"), F.col("l_partkey").alias("sku"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "l_orderkey", "l_linenumber")
    first = rows.where("upload = 'O'").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn(
        "order_date", F.when((F.col("upload") == "O") & (F.struct("l_orderkey", "l_linenumber")
                                                         == F.col("first")), "someday")
        .otherwise(F.col("order_date"))).drop("first")
    # a header of four names above rows of five fields
    text = F.concat_ws(",", "sku", "quantity", "price", "order_date",
                       F.when(F.col("upload") == "P", F.lit("5")))
    src = scratch_path(spark, "chain-src")
    order = ["l_orderkey", "l_linenumber"]
    _as_parts(rows.select("upload", text.alias("sku,quantity,price,order_date"), *order), "upload",
              order, src, without=order, quote="", sep="\u0001")
    known = t.lineitem.select(F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"),
                              F.col("l_extendedprice").alias("price"),
                              F.col("l_shipdate").alias("order_date"))
    model = demand.train_demand(demand.demand_features(known))

    def predict(inputs):
        return demand.score_demand(model, demand.demand_features(inputs, keep=["upload_id", "row"]),
                                   keep=["upload_id", "row"])

    out, ckpt = scratch_path(spark, "chain-out"), scratch_path(spark, "chain-ckpt")
    chain.run_chain(records.line_stream(spark, src), out, ckpt, predict,
                    _upload_of("upload")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "pipeline_runs")).select(
        F.col("upload_id").alias("upload"), "seq", "status", "message")
