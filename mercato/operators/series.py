"""Daily series: the shared input of anomaly detection and forecasting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators._util import attach_group_stats, keys, ordered_index


def _sum_value(value_col: str, value_scale: int | None):
    v = F.col(value_col)
    if value_scale is None:
        return F.coalesce(F.sum(v.cast("double")), F.lit(0.0))
    # Exact, order-independent money sums: DECIMAL(38, scale), back to DOUBLE.
    return F.coalesce(F.sum(v.cast(f"decimal(18,{value_scale})")).cast("double"), F.lit(0.0))


def daily_totals(df: DataFrame, date_col: str = "order_date", value_col: str = "quantity",
                 group_cols: Sequence[str] = (), grain: str = "day",
                 value_scale: int | None = None,
                 out_date: str = "date", out_value: str = "total") -> DataFrame:
    """Sum of ``value_col`` per (group, day).

    Rows without a date are dropped and missing values are skipped (an
    all-missing day sums to 0).  ``grain="raw"`` groups on the raw value of
    ``date_col`` instead of its calendar day.  Hash aggregation with a
    map-side partial step: the shuffle carries one row per
    (partition, group, day), never raw rows.
    """
    g = keys(group_cols)
    d = F.col(date_col)
    d = F.to_date(d) if grain == "day" else d
    return (df.where(F.col(date_col).isNotNull())
            .groupBy(*g, d.alias(out_date))
            .agg(_sum_value(value_col, value_scale).alias(out_value)))


def with_day_index(daily: DataFrame, date_col: str = "date", group_cols: Sequence[str] = (),
                   out: str = "day_index", n_out: str | None = None) -> DataFrame:
    """0..n-1 over the *observed* days of each series (gaps are not filled),
    optionally with the series length in ``n_out``.

    A calendar-day series holds at most 366 rows a year, so it is numbered by
    one window per series over the aggregated table, in the same pass that
    produced it.  Any other order (raw timestamps, numbers) can be unbounded
    and uses the two-level index of ``ordered_index`` instead.
    """
    g = keys(group_cols)
    if dict(daily.dtypes)[date_col] == "date":
        w = Window.partitionBy(*g)
        out_df = daily.withColumn(out, (F.row_number().over(w.orderBy(date_col)) - 1).cast("long"))
        if n_out:
            out_df = out_df.withColumn(n_out, F.count(F.lit(1)).over(w))
        return out_df
    out_df = ordered_index(daily, date_col, g, out=out)
    if n_out:
        sizes = daily.groupBy(*g).agg(F.count(F.lit(1)).alias(n_out))
        out_df = attach_group_stats(out_df, sizes, g)
    return out_df
