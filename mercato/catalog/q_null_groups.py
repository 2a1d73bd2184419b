"""The grouped flows on uploads of which one has no id (orders that are
pending): a null group is a group like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import ORACLE_SQL, register
from mercato.catalog.q_stream import INSIGHT_COUNTS_SQL
from mercato.operators import clean
from mercato.plans import insights_doc, preprocess
from mercato.sources.tables import Tables


def _upload(status: str = "o_orderstatus"):
    return F.when(F.col(status) != "P", F.col(status)).alias("upload")


@register("clean_null_groups", sql="""
WITH j AS (
  SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS upload,
         CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice) END AS price,
         CASE WHEN o_totalprice <= 200000 THEN o_orderpriority END AS priority,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note
  FROM orders),
m AS (SELECT upload, avg(price) AS price FROM j GROUP BY upload),
k AS (SELECT upload, priority, row_number() OVER (PARTITION BY upload
             ORDER BY count(*) DESC, priority) AS place
      FROM j WHERE priority IS NOT NULL GROUP BY upload, priority)
SELECT o_orderkey, j.upload, coalesce(j.price, m.price) AS price,
       coalesce(j.priority, k.priority) AS priority, note
FROM j JOIN m ON j.upload IS NOT DISTINCT FROM m.upload
LEFT JOIN k ON j.upload IS NOT DISTINCT FROM k.upload AND k.place = 1""")
def q_clean_null_groups(spark, sf_dir):
    """Imputation by upload: every row once, filled from its own upload.  A
    column without any value in an upload stays null there."""
    o = Tables(spark, sf_dir).orders.select(
        "o_orderkey", _upload(),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("double"))
        .alias("price"),
        F.when(F.col("o_totalprice") <= 200000, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("note"))
    return clean.clean_missing(o, ["upload"], cols=["price", "priority", "note"])


@register("preprocess_null_upload", sql=f"""
SELECT NULLIF(o_orderstatus, 'P') AS upload, record_count, column_count, anomaly_count,
       CASE WHEN record_count >= 5 THEN 7 ELSE 0 END AS forecast_days, 5 AS summaries
FROM ({ORACLE_SQL["preprocess_counts"]})""")
def q_preprocess_null_upload(spark, sf_dir):
    """Counts of the preprocess document with its parts all there."""
    o = Tables(spark, sf_dir).orders
    o = o.select(_upload(), *[c for c in o.columns if c != "o_orderstatus"])
    doc = preprocess.preprocess(o, group_cols=["upload"], strict_roles=True).document()
    return doc.select("upload", "record_count", "column_count", "anomaly_count",
                      F.size("forecast").alias("forecast_days"),
                      F.size("summary_stats").alias("summaries"))


@register("insights_null_upload", sql=f"""
SELECT NULLIF(c.upload, 'P') AS upload, c.rows, c.churn_at_risk_count, c.anomaly_count,
       least(5, s.skus)::INTEGER AS top_skus
FROM ({INSIGHT_COUNTS_SQL}) c
JOIN (SELECT o_orderstatus AS upload, count(DISTINCT l_partkey) AS skus
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus) s
  ON c.upload = s.upload""")
def q_insights_null_upload(spark, sf_dir):
    """Counts of the insights document and its number of top items."""
    t = Tables(spark, sf_dir)
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(_upload(), F.col("l_partkey").alias("sku"),
                    F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("order_date"),
                    F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id")))
    doc = insights_doc.insights_document(rows, ["upload"], "row_id")
    return doc.select("upload", F.col("summary.rows").alias("rows"),
                      "insights.churn_at_risk_count", "insights.anomaly_count",
                      F.size("insights.top_skus").alias("top_skus"))
