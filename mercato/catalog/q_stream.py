"""Ingest queries: the file stream over new uploads, and the CSV export /
upload round trip."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.session import scratch_path
from mercato.operators._util import attach_group_stats
from mercato.sources import records, sinks, uploads
from mercato.sources.tables import Tables
from mercato.streaming import ingest


def _analyse_events(batch):
    """Per upload (user) of one micro-batch: rows, exact value total, first
    and last event time."""
    return batch.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_value"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("stream_ingest_counts", sql="""
SELECT user_id AS upload_id, count(*) AS rows,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY user_id""")
def q_stream_ingest_counts(spark, sf_dir):
    """Stream the events file as newly arrived data (available-now trigger,
    checkpointed), analyse each micro-batch per upload into a
    batch-partitioned sink, then combine the batches."""
    schema = Tables(spark, sf_dir).events.schema
    # a pattern matches the table as one file and as a folder of part files
    stream = (ingest.upload_stream(spark, os.path.join(sf_dir, "event[s].parquet"), schema,
                                   fmt="parquet", glob="*.parquet")
              .withColumn("upload_id", F.col("user_id")))
    out_dir, ckpt = scratch_path(spark, "ingest-out"), scratch_path(spark, "ingest-ckpt")
    q = ingest.run_ingest(stream, out_dir, ckpt, _analyse_events, available_now=True)
    q.awaitTermination()
    res = spark.read.parquet(os.path.join(out_dir, "analyses"))
    return res.groupBy("upload_id").agg(
        F.sum("rows").alias("rows"), F.sum("total_value").cast("double").alias("total_value"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


@register("upload_roundtrip", sql="""
SELECT o_orderstatus, count(*) AS rows,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
       max(strftime(o_orderdate, '%Y-%m-%d')) AS last_order_date,
       count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY o_orderstatus""")
def q_upload_roundtrip(spark, sf_dir):
    """Export orders as CSV uploads (dates as yyyy-MM-dd), read every CSV
    file back as uploads with missing-token handling and all-or-nothing type
    inference, and summarise what was read."""
    out = scratch_path(spark, "uploads")
    sinks.export_csv(Tables(spark, sf_dir).orders, out, date_cols=["o_orderdate"])
    up = uploads.read_uploads(spark, out)
    assert dict(up.dtypes)["o_totalprice"] == "double", up.dtypes
    return up.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_price"),
        F.max("o_orderdate").alias("last_order_date"),
        F.countDistinct("o_custkey").alias("customers"))


_UPLOAD_SCHEMA = ("sku long, quantity double, price double, customer_id long, "
                  "order_date string, row_id string")


INSIGHT_COUNTS_SQL = """
WITH r AS (
  SELECT o.o_orderstatus AS upload, l.l_partkey AS sku, l.l_quantity AS quantity,
         l.l_extendedprice AS price, o.o_custkey AS customer_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS order_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
n AS (SELECT upload, count(*) AS rows FROM r GROUP BY upload),
lastd AS (SELECT upload, customer_id, max(order_date) AS last_d FROM r
          WHERE customer_id IS NOT NULL GROUP BY upload, customer_id),
cut AS (SELECT upload, max(order_date) - INTERVAL 90 DAY AS cutoff FROM r GROUP BY upload),
risk AS (SELECT l.upload, CAST(count_if(l.last_d < c.cutoff) AS BIGINT) AS churn_at_risk_count
         FROM lastd l JOIN cut c ON l.upload = c.upload GROUP BY l.upload),
st AS (SELECT upload, sku, avg(price) AS m, stddev_samp(price) AS sd FROM r
       WHERE sku IS NOT NULL GROUP BY upload, sku HAVING count(*) >= 5),
anom AS (SELECT r.upload, count(*) AS anomaly_count FROM r JOIN st
           ON r.upload = st.upload AND r.sku = st.sku
         WHERE r.price > st.m + 3 * st.sd OR r.price < st.m - 3 * st.sd GROUP BY r.upload)
SELECT n.upload, n.rows, risk.churn_at_risk_count,
       coalesce(anom.anomaly_count, 0) AS anomaly_count
FROM n JOIN risk ON n.upload = risk.upload LEFT JOIN anom ON n.upload = anom.upload"""


@register("stream_upload_insights", sql=INSIGHT_COUNTS_SQL)
def q_stream_upload_insights(spark, sf_dir):
    """Line items exported as CSV uploads (one folder per order status), then
    ingested by the checkpointed file stream; each micro-batch runs the
    quick insights for all of its uploads at once."""
    t = Tables(spark, sf_dir)
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
            .select(F.col("o_orderstatus").alias("upload"), F.col("l_partkey").alias("sku"),
                    F.col("l_quantity").alias("quantity"),
                    F.col("l_extendedprice").alias("price"),
                    F.col("o_custkey").alias("customer_id"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                    F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id")))
    src = scratch_path(spark, "upload-src")
    rows.write.partitionBy("upload").option("header", True).csv(src)
    stream = ingest.upload_stream(spark, src)

    def bind(lines):
        return records.bound(records.cells(lines), _UPLOAD_SCHEMA).withColumn(
            "upload_id", F.regexp_extract("upload_file", "/upload=([^/]+)/", 1))

    out_dir, ckpt = scratch_path(spark, "upload-out"), scratch_path(spark, "upload-ckpt")
    q = ingest.run_ingest(stream, out_dir, ckpt,
                          lambda b: ingest.upload_insights(b, "upload_id", "row_id"), bind=bind)
    q.awaitTermination()
    res = spark.read.parquet(os.path.join(out_dir, "analyses"))
    return res.select(F.col("upload_id").alias("upload"), "rows", "churn_at_risk_count",
                      "anomaly_count")


@register("upload_mixed_headers", sql="""
SELECT part, count(*) AS rows,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
       sum(o_orderkey)::BIGINT AS keys,
       count(DISTINCT 'say "' || o_orderpriority || '"' || chr(10) || 'twice, ' || o_orderstatus)
           AS notes,
       count(CASE WHEN part = 'odd' THEN 1 END) AS extras
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM orders)
GROUP BY part""")
def q_upload_mixed_headers(spark, sf_dir):
    """Orders exported as CSV uploads with two column orders, one of them
    with a further column, and notes that hold quotes, commas and line
    breaks; read back by each file's own header."""
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('"\ntwice, '), "o_orderstatus")
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice", note.alias("note"))
    out = scratch_path(spark, "mixed")
    even, odd = (o.where(F.col("o_orderkey") % 2 == i) for i in (0, 1))
    for df, name in ((even.select("o_orderkey", "note", "o_totalprice"), "even"),
                     (odd.select("o_totalprice", "note", F.lit(1).alias("extra"), "o_orderkey"),
                      "odd")):
        df.write.option("header", True).option("escape", '"').csv(f"{out}/{name}")
    up = uploads.read_uploads(spark, [f"{out}/even", f"{out}/odd"])
    part = F.when(F.col("upload_file").contains("/even/"), "even").otherwise("odd")
    return up.groupBy(part.alias("part")).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_price"),
        F.sum("o_orderkey").alias("keys"), F.countDistinct("note").alias("notes"),
        F.count("extra").alias("extras"))


@register("stream_mixed_headers", sql="""
SELECT o_orderstatus AS part, count(*) AS rows,
       coalesce(CAST(SUM(CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'
                         THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS total_price,
       sum(o_orderkey)::BIGINT AS keys,
       count(DISTINCT 'say "' || o_orderpriority || '"' || chr(10) || 'twice, NA') AS notes,
       count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS extras
FROM orders GROUP BY o_orderstatus""")
def q_stream_mixed_headers(spark, sf_dir):
    """Orders as a stream of CSV uploads: a header for each status, with
    other column orders, an extra column, quotes, line breaks and
    missing-value tokens, each bound by its own file's header."""
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('"\ntwice, NA'))
    o = Tables(spark, sf_dir).orders.select(
        "o_orderstatus", "o_orderkey", note.alias("note"), F.lit(1).alias("extra"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "NA")
        .otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    src = scratch_path(spark, "mixed-stream")
    shapes = {"F": ["o_orderkey", "note", "price"], "O": ["price", "extra", "note", "o_orderkey"],
              "P": ["note", "price", "o_orderkey"]}
    for status, names in shapes.items():
        o.where(F.col("o_orderstatus") == status).select(*names).write.option(
            "header", True).option("escape", '"').csv(f"{src}/{status}")
    stream = ingest.upload_stream(spark, src + "/*")

    def summary(batch):
        part = F.regexp_extract("upload_file", "/([FOP])/[^/]*$", 1)
        return batch.groupBy(part.alias("upload_id")).agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.col("price").cast("decimal(18,2)")).cast("double"), F.lit(0.0))
            .alias("total_price"), F.sum("o_orderkey").alias("keys"),
            F.countDistinct("note").alias("notes"), F.count("extra").alias("extras"))

    out_dir, ckpt = scratch_path(spark, "mixed-out"), scratch_path(spark, "mixed-ckpt")
    schema = "o_orderkey long, note string, price string, extra int"
    ingest.run_ingest(stream, out_dir, ckpt, summary, bind=ingest.by_header(schema)
                      ).awaitTermination()
    return (spark.read.parquet(os.path.join(out_dir, "analyses")).drop("batch_id")
            .withColumnRenamed("upload_id", "part"))


@register("upload_types_isolated", sql="""
WITH u AS (SELECT o_orderkey % 3 AS upload_id, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey =
                  (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 3 = 1)
                  THEN 'bad' ELSE o_totalprice::VARCHAR END AS price FROM orders),
ok AS (SELECT upload_id, bool_and(try_cast(price AS DOUBLE) IS NOT NULL) AS numeric
       FROM u GROUP BY upload_id)
SELECT upload_id, count(*) AS rows,
       count(CASE WHEN numeric THEN price END) AS numbers,
       coalesce(CAST(SUM(CASE WHEN numeric THEN CAST(price AS DECIMAL(18,2)) END) AS DOUBLE), 0)
           AS total_price
FROM u JOIN ok USING (upload_id) GROUP BY upload_id""")
def q_upload_types_isolated(spark, sf_dir):
    """Three uploads of order prices as text; one holds a bad number, the
    others keep theirs."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    first = o.where("o_orderkey % 3 = 1").agg(F.min("o_orderkey").alias("first"))
    u = o.crossJoin(F.broadcast(first)).select(
        (F.col("o_orderkey") % 3).alias("upload_id"),
        F.when(F.col("o_orderkey") == F.col("first"), F.lit("bad"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    typed = uploads.with_upload_numbers(u, ["price"])
    return typed.groupBy("upload_id").agg(
        F.count("*").alias("rows"), F.count("price_number").alias("numbers"),
        F.coalesce(F.sum(F.col("price_number").cast("decimal(18,2)")).cast("double"), F.lit(0.0))
        .alias("total_price"))


@register("insert_verdicts", sql="""
WITH lim AS (SELECT min(o_orderdate) + INTERVAL 365 DAY AS lim FROM orders),
known AS (SELECT DISTINCT o_custkey FROM orders, lim WHERE o_orderdate < lim),
incoming AS (
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS c, l_orderkey, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY l_orderkey, l_linenumber) AS n
      FROM incoming)
SELECT CASE WHEN c IS NULL THEN 'missing required field: c'
            WHEN c IN (SELECT o_custkey FROM known) THEN 'already exists'
            WHEN n > 1 THEN 'duplicate key in batch' ELSE 'accepted' END AS verdict,
       count(*) AS rows FROM r GROUP BY 1""")
def q_insert_verdicts(spark, sf_dir):
    """The customers of all line items as an insert batch into the base of
    those who ordered in the first year: every row is accepted or rejected
    with a reason.  Pending orders don't name their customer."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    incoming = (t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("c"),
                        "l_orderkey", "l_linenumber"))
    lim = o.agg((F.min("o_orderdate") + F.make_interval(days=F.lit(365))).alias("lim"))
    known = (attach_group_stats(o, lim, []).where(F.col("o_orderdate") < F.col("lim"))
             .select(F.col("o_custkey").alias("c")).distinct())
    accepted, rejected = sinks.new_rows_only(known, incoming, ["c"], ["c"])
    return (accepted.withColumn("verdict", F.lit("accepted")).select("verdict")
            .union(rejected.select("reason")).groupBy("verdict").agg(F.count("*").alias("rows")))


@register("null_key_outliers", sql="""
WITH d AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 50 END AS item,
                  l_quantity::DOUBLE AS x FROM lineitem),
s AS (SELECT item, min(x) AS low, count(*) AS n FROM d GROUP BY item)
SELECT d.item, count(*) AS rows, count_if(d.x = s.low)::BIGINT AS lowest
FROM d JOIN s ON d.item IS NOT DISTINCT FROM s.item GROUP BY d.item""")
def q_null_key_outliers(spark, sf_dir):
    """Group statistics attached to rows keep the group of null keys."""
    d = Tables(spark, sf_dir).lineitem.select(
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_partkey") % 50)
        .alias("item"), F.col("l_quantity").cast("double").alias("x"))
    stats = d.groupBy("item").agg(F.min("x").alias("low"))
    both = attach_group_stats(d, stats, ["item"])
    return both.groupBy("item").agg(F.count("*").alias("rows"),
                                    F.count_if(F.col("x") == F.col("low")).alias("lowest"))
