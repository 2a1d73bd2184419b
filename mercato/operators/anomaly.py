"""Mean +- k*sigma outlier flags on daily series, rows, and per-item groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.coerce import lenient_number, lenient_number_or_zero
from mercato.operators._util import attach_group_stats, keys, salted_join
from mercato.operators.series import daily_totals

# The daily and per-customer detectors flag values more than 2
# sample standard deviations from the mean; the per-item price check uses 3
# and skips items with fewer than 5 rows.
DAILY_SIGMAS = 2.0
ROW_SIGMAS = 2.0
ITEM_SIGMAS = 3.0
ITEM_MIN_ROWS = 5


def _outside(v, mean, std, k: float):
    return (v > mean + F.lit(k) * std) | (v < mean - F.lit(k) * std)


def series_stats(daily: DataFrame, value_col: str = "total", group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean, sample std and day count per series (one row per series)."""
    return daily.groupBy(*keys(group_cols)).agg(
        F.avg(value_col).alias("mean"),
        F.stddev_samp(value_col).alias("std"),
        F.count(F.lit(1)).alias("n_days"))


def flag_series_anomalies(daily: DataFrame, value_col: str = "total",
                          group_cols: Sequence[str] = (), k: float = DAILY_SIGMAS,
                          bounded: bool = False) -> DataFrame:
    """Rows of an already aggregated series whose value lies outside
    mean +- k*std of their series.  A one-day series has a NULL std and
    yields nothing.

    ``bounded`` series (calendar days: at most 366 rows a year) get their
    statistics from a window per series in the same pass; otherwise the
    statistics are a separate aggregate joined back (salted)."""
    g = keys(group_cols)
    if bounded:
        w = Window.partitionBy(*g)
        flagged = (daily.withColumn("mean", F.avg(value_col).over(w))
                   .withColumn("std", F.stddev_samp(value_col).over(w))
                   .withColumn("n_days", F.count(F.lit(1)).over(w)))
    else:
        flagged = attach_group_stats(daily, series_stats(daily, value_col, g), g)
    return flagged.where(_outside(F.col(value_col), F.col("mean"), F.col("std"), k))


def daily_anomalies(df: DataFrame, date_col: str = "order_date", value_col: str = "quantity",
                    group_cols: Sequence[str] = (), k: float = DAILY_SIGMAS,
                    grain: str = "day", value_scale: int | None = None) -> DataFrame:
    """Days whose total lies outside mean +- k*std of the daily totals.

    Plan: partial+final hash aggregate to one row per day, then the series
    mean/std from a window per series over that small table (one scan of
    the input).  Raw rows are shuffled only as pre-aggregated partial sums.
    """
    daily = daily_totals(df, date_col, value_col, group_cols, grain=grain,
                         value_scale=value_scale)
    return flag_series_anomalies(daily, "total", group_cols, k, bounded=(grain == "day"))


def row_anomalies(df: DataFrame, value_col: str = "Total Spend", group_cols: Sequence[str] = (),
                  k: float = ROW_SIGMAS) -> DataFrame:
    """Rows whose value (lenient numeric, bad -> 0) lies outside mean +- k*std
    over all rows of their group.  A missing column yields no rows."""
    if value_col not in df.columns:
        return df.limit(0)
    g = keys(group_cols)
    clean = df.withColumn(value_col, lenient_number_or_zero(value_col))
    stats = clean.groupBy(*g).agg(F.avg(value_col).alias("mean"),
                                  F.stddev_samp(value_col).alias("std"))
    return (attach_group_stats(clean, stats, g)
            .where(_outside(F.col(value_col), F.col("mean"), F.col("std"), k)))


def item_price_outliers(df: DataFrame, item_col: str = "sku", price_col: str = "price",
                        row_id_col: str | None = None, group_cols: Sequence[str] = (),
                        k: float = ITEM_SIGMAS, min_rows: int = ITEM_MIN_ROWS) -> DataFrame:
    """Rows whose price lies outside mean +- k*std of their item's prices,
    for items with at least ``min_rows`` rows (rows with an unparsable price
    count toward the gate but are never flagged).

    The per-item statistics are a partial aggregate (one row per item), joined
    back on the item key with a salted join, so a hot item's rows are spread
    over several tasks and never sorted or held in one (AQE may still
    broadcast the statistics when they are small).  Emits item, row id, price.
    """
    g = keys(group_cols)
    rows = df.withColumn(price_col, lenient_number(price_col))
    stats = (rows.where(F.col(item_col).isNotNull())
             .groupBy(*g, item_col)
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.avg(price_col).alias("mean"),
                  F.stddev_samp(price_col).alias("std"))
             .where(F.col("n_rows") >= min_rows))
    out = (salted_join(rows, stats, [*g, item_col])
           .where(_outside(F.col(price_col), F.col("mean"), F.col("std"), k)))
    cols = [*g, item_col] + ([row_id_col] if row_id_col else []) + [price_col, "mean", "std"]
    return out.select(*cols)
