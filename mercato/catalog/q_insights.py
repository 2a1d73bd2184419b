"""Quick-insight queries: top items, inactive customers, dataset summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import insights, profile
from mercato.catalog.q_stream import INSIGHT_COUNTS_SQL
from mercato.plans import insights_doc
from mercato.sources.tables import Tables


@register("top_items", headline=True, sql="""
SELECT l_partkey, SUM(COALESCE(TRY_CAST(l_quantity AS DOUBLE), 0)) AS total_quantity
FROM lineitem WHERE l_partkey IS NOT NULL
GROUP BY l_partkey ORDER BY total_quantity DESC, l_partkey ASC LIMIT 5""")
def q_top_items(spark, sf_dir):
    return insights.top_items(Tables(spark, sf_dir).lineitem, "l_partkey", "l_quantity", n=5)


_AT_RISK_SQL = """
WITH l AS (
  SELECT o_custkey, max(o_orderdate) AS last_order_date FROM orders
  WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL GROUP BY o_custkey)
SELECT o_custkey, last_order_date FROM l
WHERE last_order_date < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY"""


@register("churn_at_risk", headline=True, sql=_AT_RISK_SQL)
def q_churn_at_risk(spark, sf_dir):
    out = insights.customers_at_risk(Tables(spark, sf_dir).orders, "o_custkey", "o_orderdate")
    return out.select("o_custkey", F.col("last_order_date").cast("timestamp_ntz")
                      .alias("last_order_date"))


@register("churn_at_risk_count", sql=f"""
SELECT count(*) AS churn_at_risk_count FROM ({_AT_RISK_SQL}) r""")
def q_churn_at_risk_count(spark, sf_dir):
    return insights.customers_at_risk_count(Tables(spark, sf_dir).orders, "o_custkey",
                                            "o_orderdate")


@register("dataset_summary", sql="""
SELECT count(*) AS rows, 6 AS column_count,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
       max(o_orderdate) AS last_order_date
FROM orders""")
def q_dataset_summary(spark, sf_dir):
    s = profile.dataset_summary(Tables(spark, sf_dir).orders, "o_orderdate")
    return s.select("rows", "column_count", F.array_join("columns", ",").alias("columns"),
                    "last_order_date")


@register("insights_document")
def q_insights_document(spark, sf_dir):
    """One nested insight document per order status (as an upload id)."""
    t = Tables(spark, sf_dir)
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
            .select(F.col("o_orderstatus").alias("upload_id"),
                    F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity"),
                    F.col("l_extendedprice").alias("price"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").alias("order_date"),
                    F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_id")))
    return insights_doc.insights_document(rows, group_cols=["upload_id"], row_id_col="row_id")


@register("insights_counts", sql=INSIGHT_COUNTS_SQL)
def q_insights_counts(spark, sf_dir):
    """The counts of the insight document per upload (order status), from
    the batch path: rows, customers at risk, item price outliers."""
    doc = q_insights_document(spark, sf_dir)
    return doc.select(F.col("upload_id").alias("upload"), F.col("summary.rows").alias("rows"),
                      F.col("insights.churn_at_risk_count").alias("churn_at_risk_count"),
                      F.col("insights.anomaly_count").alias("anomaly_count"))
