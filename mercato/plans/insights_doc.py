"""Quick-insights document of order uploads, one row per upload.

Each insight runs only when its columns exist (decided at plan time from the
schema).  All pieces are per-upload aggregates joined on the upload keys, so
one job serves every upload at once.  The price-outlier rows are not folded
into an array: their number grows with the data, so the document carries
their count and :func:`insights` returns them as their own table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators import anomaly, insights as ins, profile
from mercato.operators._util import keys, null_safe_join


@dataclass
class Insights:
    document: DataFrame
    price_outliers: DataFrame | None


def _join_all(parts: list[DataFrame], g: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = null_safe_join(out, p, g, "left")
    return out


def insights(df: DataFrame, group_cols: Sequence[str] = (), row_id_col: str | None = None,
             item_col: str = "sku", qty_col: str = "quantity", price_col: str = "price",
             customer_col: str = "customer_id", date_col: str = "order_date") -> Insights:
    g = keys(group_cols)
    cols = set(df.columns)
    summary = profile.dataset_summary(df, date_col if date_col in cols else None, g)
    summary = summary.select(*g, F.struct("rows", "columns", F.col("last_order_date")
                                          .cast("string").alias("last_order_date"))
                             .alias("summary"))
    parts = [summary]
    if {item_col, qty_col} <= cols:
        top = ins.top_items(df, item_col, qty_col, ins.TOP_ITEMS, g)
        if not g:
            top = top.agg(F.map_from_entries(F.collect_list(F.struct(
                F.col(item_col).cast("string"), "total_quantity"))).alias("top_skus"))
        else:
            top = top.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct(
                F.col(item_col).cast("string"), "total_quantity"))).alias("top_skus"))
        parts.append(top)
    if {customer_col, date_col} <= cols:
        parts.append(ins.customers_at_risk_count(df, customer_col, date_col, group_cols=g))
    outliers = None
    if {item_col, price_col} <= cols:
        outliers = anomaly.item_price_outliers(df, item_col, price_col, row_id_col, g)
        counts = outliers.groupBy(*g).agg(F.count(F.lit(1)).alias("anomaly_count"))
        parts.append(counts)
    doc = _join_all(parts, g)
    fields = [c for c in ("top_skus", "churn_at_risk_count", "anomaly_count") if c in doc.columns]
    if "anomaly_count" in doc.columns:
        doc = doc.withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
    return Insights(doc.select(*g, "summary", F.struct(*fields).alias("insights")), outliers)


def insights_document(df: DataFrame, group_cols: Sequence[str] = (),
                      row_id_col: str | None = None, **kw) -> DataFrame:
    return insights(df, group_cols, row_id_col, **kw).document
