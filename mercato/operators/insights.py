"""Quick insights of an order upload: top items, inactive customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.coerce import lenient_number_or_zero, lenient_timestamp
from mercato.operators._util import attach_group_stats, keys

# 5 top items; a customer is at risk when their last order is
# more than 90 days before the latest order date of the upload.
TOP_ITEMS = 5
INACTIVE_DAYS = 90


def item_totals(df: DataFrame, item_col: str = "sku", qty_col: str = "quantity",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Total quantity per item (bad quantities count as 0)."""
    g = keys(group_cols)
    return (df.where(F.col(item_col).isNotNull())
            .groupBy(*g, item_col)
            .agg(F.sum(lenient_number_or_zero(qty_col)).alias("total_quantity")))


def top_items(df: DataFrame, item_col: str = "sku", qty_col: str = "quantity",
              n: int = TOP_ITEMS, group_cols: Sequence[str] = ()) -> DataFrame:
    """The ``n`` items with the largest total quantity (ties -> smaller item
    first).  Without groups this plans as TakeOrderedAndProject (a per-task
    top-n, then a merge of n x tasks rows); with groups the row_number
    filter is planned with a per-partition group limit before the shuffle."""
    g = keys(group_cols)
    totals = item_totals(df, item_col, qty_col, g)
    order = [F.col("total_quantity").desc(), F.col(item_col).asc()]
    if not g:
        return totals.orderBy(*order).limit(n)
    w = Window.partitionBy(*g).orderBy(*order)
    return totals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _as_ts(df: DataFrame, date_col: str):
    t = dict(df.dtypes)[date_col]
    return lenient_timestamp(date_col) if t == "string" else F.col(date_col).cast("timestamp")


def customers_at_risk(df: DataFrame, customer_col: str = "customer_id",
                      date_col: str = "order_date", days: int = INACTIVE_DAYS,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Customers whose last order is strictly before (latest order date -
    ``days`` days).  Rows with no parsable date are ignored."""
    g = keys(group_cols)
    d = df.select(*g, customer_col, _as_ts(df, date_col).alias("__d")).where(
        F.col("__d").isNotNull())
    last = (d.where(F.col(customer_col).isNotNull()).groupBy(*g, customer_col)
            .agg(F.max("__d").alias("last_order_date")))
    cutoff = d.groupBy(*g).agg(
        (F.max("__d") - F.make_interval(days=F.lit(days))).alias("cutoff"))
    return (attach_group_stats(last, cutoff, g)
            .where(F.col("last_order_date") < F.col("cutoff"))
            .select(*g, customer_col, "last_order_date"))


def customers_at_risk_count(df: DataFrame, customer_col: str = "customer_id",
                            date_col: str = "order_date", days: int = INACTIVE_DAYS,
                            group_cols: Sequence[str] = ()) -> DataFrame:
    """Number of at-risk customers per group (0 when none)."""
    g = keys(group_cols)
    d = df.select(*g, customer_col, _as_ts(df, date_col).alias("__d")).where(
        F.col("__d").isNotNull())
    last = (d.where(F.col(customer_col).isNotNull()).groupBy(*g, customer_col)
            .agg(F.max("__d").alias("__last")))
    cutoff = d.groupBy(*g).agg((F.max("__d") - F.make_interval(days=F.lit(days)))
                               .alias("__cutoff"))
    return (attach_group_stats(last, cutoff, g).groupBy(*g)
            .agg(F.count_if(F.col("__last") < F.col("__cutoff")).alias("churn_at_risk_count")))
