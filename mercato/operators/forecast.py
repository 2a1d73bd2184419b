"""Per-series forecasts over daily totals: linear trend, moving average, naive.

Every method works on the aggregated daily table (one row per series x day),
so raw rows only ever flow through the partial/final hash aggregate that
builds it.  Each method returns one row per (series, step).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators._util import keys
from mercato.operators.series import daily_totals, with_day_index

# Default horizon and moving-average window are 7 days.
DAYS_AHEAD = 7
MA_WINDOW = 7


def _exact(v: str, value_scale: int | None):
    """The value as an exact DECIMAL when a scale is known, else DOUBLE."""
    c = F.col(v)
    return c.cast(f"decimal(30,{value_scale})") if value_scale is not None else c.cast("double")


def _sum(expr):
    return F.sum(expr).cast("double")


def linear_trend(daily: DataFrame, date_col: str = "date", value_col: str = "total",
                 group_cols: Sequence[str] = (), value_scale: int | None = None) -> DataFrame:
    """Ordinary least squares of the daily value on its observed-day index,
    one row per series: n, slope, intercept, last_date.

    Closed form from five sums, where sum(i) and sum(i^2) are known from n.
    With ``value_scale`` the two value sums are exact DECIMALs, so the model
    does not depend on the order in which partitions are merged.  A one-day
    series has slope 0 and intercept equal to its value.
    """
    g = keys(group_cols)
    idx = with_day_index(daily, date_col, g)
    y = _exact(value_col, value_scale)
    sums = idx.groupBy(*g).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        _sum(y).alias("sy"),
        _sum(F.col("day_index") * y).alias("sxy"),
        F.max(date_col).alias("last_date")).where(F.col("n") > 0)
    n = F.col("n")
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    slope = F.coalesce(F.try_divide(n * F.col("sxy") - sx * F.col("sy"), n * sxx - sx * sx),
                       F.lit(0.0))
    return (sums.withColumn("slope", slope)
            .withColumn("intercept", (F.col("sy") - F.col("slope") * sx) / n)
            .select(*g, n.cast("long").alias("n"), "slope", "intercept", "last_date"))


def _steps(days_ahead: int):
    return F.explode(F.sequence(F.lit(1), F.lit(days_ahead))).alias("step")


def forecast_linear(df: DataFrame, date_col: str = "order_date", value_col: str = "quantity",
                    days_ahead: int = DAYS_AHEAD, group_cols: Sequence[str] = (),
                    value_scale: int | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Linear-trend forecast for day indexes n .. n+days_ahead-1 (negative
    forecasts allowed).  Columns: group keys, day_index, forecast."""
    g = keys(group_cols)
    if daily is None:
        daily = daily_totals(df, date_col, value_col, g, value_scale=value_scale)
    model = linear_trend(daily, "date", "total", g, value_scale)
    return (model.select(*g, "n", "slope", "intercept", _steps(days_ahead))
            .withColumn("day_index", (F.col("n") + F.col("step") - 1).cast("long"))
            .withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("day_index"))
            .select(*g, "day_index", "forecast"))


def _dated(base: DataFrame, g: list[str], days_ahead: int) -> DataFrame:
    return (base.select(*g, "last_date", "forecast", _steps(days_ahead))
            .withColumn("date", F.date_add("last_date", F.col("step")))
            .select(*g, "step", "date", "forecast"))


def forecast_moving_average(df: DataFrame, date_col: str = "order_date",
                            value_col: str = "quantity", days_ahead: int = DAYS_AHEAD,
                            window: int = MA_WINDOW, group_cols: Sequence[str] = (),
                            value_scale: int | None = None,
                            daily: DataFrame | None = None) -> DataFrame:
    """Flat forecast equal to the mean of the last ``window`` observed days,
    dated from the day after the last observed day."""
    g = keys(group_cols)
    if daily is None:
        daily = daily_totals(df, date_col, value_col, g, value_scale=value_scale)
    idx = with_day_index(daily, "date", g, n_out="n")
    last = (idx.where(F.col("day_index") >= F.col("n") - window)
            .groupBy(*g)
            .agg((_sum(_exact("total", value_scale)) / F.count(F.lit(1))).alias("forecast"),
                 F.max("date").alias("last_date")))
    return _dated(last, g, days_ahead)


def forecast_naive(df: DataFrame, date_col: str = "order_date", value_col: str = "quantity",
                   days_ahead: int = DAYS_AHEAD, group_cols: Sequence[str] = (),
                   value_scale: int | None = None, daily: DataFrame | None = None) -> DataFrame:
    """Flat forecast equal to the last observed day's value."""
    g = keys(group_cols)
    if daily is None:
        daily = daily_totals(df, date_col, value_col, g, value_scale=value_scale)
    last = (daily.groupBy(*g).agg(F.max("date").alias("last_date"),
                                  F.max_by("total", "date").alias("forecast"))
            .where(F.col("last_date").isNotNull()))
    return _dated(last, g, days_ahead)


def forecast_summary(forecast: DataFrame, group_cols: Sequence[str] = (),
                     order_col: str = "day_index") -> DataFrame:
    """Mean, total, maximum and first value of a forecast, per series."""
    g = keys(group_cols)
    return forecast.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.avg("forecast").alias("mean_forecast"),
        F.sum("forecast").alias("total_forecast"),
        F.max("forecast").alias("max_forecast"),
        F.min_by("forecast", order_col).alias("first_forecast"))
