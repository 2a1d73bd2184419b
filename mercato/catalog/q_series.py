"""Daily series, anomaly and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import anomaly, forecast, series
from mercato.sources.tables import Tables

# Shared SQL fragment: exact daily money totals of orders.
_DAILY_SQL = """
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""

_INDEXED_SQL = f"""
  d AS ({_DAILY_SQL}),
  i AS (SELECT date, total, row_number() OVER (ORDER BY date) - 1 AS day_index FROM d)"""


_FORECAST_LINEAR_SQL = f"""
WITH {_INDEXED_SQL},
m AS (
  SELECT CAST(count(*) AS DOUBLE) AS n,
         CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS sy,
         CAST(SUM(CAST(day_index AS DECIMAL(18,0)) * CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS sxy
  FROM i),
f AS (
  SELECT n, sy,
         n * (n - 1) / 2 AS sx,
         (n - 1) * n * (2 * n - 1) / 6 AS sxx, sxy FROM m),
g AS (
  SELECT n, sx, sy,
         coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0.0) AS slope FROM f),
h AS (SELECT n, slope, (sy - slope * sx) / n AS intercept FROM g)
SELECT CAST(n + step - 1 AS BIGINT) AS day_index,
       intercept + slope * CAST(n + step - 1 AS BIGINT) AS forecast
FROM h CROSS JOIN range(1, 8) AS r(step)"""


def _daily(spark, sf_dir):
    return series.daily_totals(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice",
                               value_scale=2)


@register("daily_totals", sql=_DAILY_SQL)
def q_daily_totals(spark, sf_dir):
    return _daily(spark, sf_dir).select("date", "total")


@register("daily_anomalies_2sigma", headline=True, sql=f"""
WITH d AS ({_DAILY_SQL}),
s AS (SELECT avg(total) AS mean, stddev_samp(total) AS std FROM d)
SELECT date, total, CASE WHEN total > mean THEN 'high' ELSE 'low' END AS direction
FROM d CROSS JOIN s
WHERE total > mean + 2 * std OR total < mean - 2 * std""")
def q_daily_anomalies(spark, sf_dir):
    out = anomaly.daily_anomalies(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice",
                                  value_scale=2)
    return out.select("date", "total",
                      F.when(F.col("total") > F.col("mean"), "high").otherwise("low")
                      .alias("direction"))


@register("customer_spend_anomalies", headline=True, sql="""
WITH c AS (
  SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
s AS (SELECT avg(total_spend) AS mean, stddev_samp(total_spend) AS std FROM c)
SELECT o_custkey, total_spend FROM c CROSS JOIN s
WHERE total_spend > mean + 2 * std OR total_spend < mean - 2 * std""")
def q_customer_spend_anomalies(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    spend = (orders.where(F.col("o_custkey").isNotNull()).groupBy("o_custkey")
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                  .alias("total_spend")))
    return anomaly.row_anomalies(spend, "total_spend").select("o_custkey", "total_spend")


@register("item_price_outliers_3sigma", headline=True, sql="""
WITH s AS (
  SELECT event_type, count(*) AS n_rows, avg(value) AS mean, stddev_samp(value) AS std
  FROM events WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(*) >= 5)
SELECT e.event_type, e.event_id, e.value
FROM events e JOIN s ON e.event_type = s.event_type
WHERE e.value > s.mean + 3 * s.std OR e.value < s.mean - 3 * s.std""")
def q_item_price_outliers(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return (anomaly.item_price_outliers(ev, "event_type", "value", row_id_col="event_id")
            .select("event_type", "event_id", "value"))


@register("forecast_linear", headline=True, sql=_FORECAST_LINEAR_SQL)
def q_forecast_linear(spark, sf_dir):
    return forecast.forecast_linear(None, days_ahead=7, daily=_daily(spark, sf_dir),
                                    value_scale=2)


@register("forecast_linear_by_segment", sql="""
WITH d AS (
  SELECT c.c_mktsegment, CAST(o.o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate IS NOT NULL GROUP BY 1, 2),
i AS (SELECT c_mktsegment, total,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY date) - 1 AS day_index FROM d),
m AS (
  SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n,
         CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS sy,
         CAST(SUM(CAST(day_index AS DECIMAL(18,0)) * CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS sxy
  FROM i GROUP BY c_mktsegment),
f AS (SELECT c_mktsegment, n, sy, n * (n - 1) / 2 AS sx,
             (n - 1) * n * (2 * n - 1) / 6 AS sxx, sxy FROM m),
g AS (SELECT c_mktsegment, n, sx, sy,
             coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0.0) AS slope FROM f),
h AS (SELECT c_mktsegment, n, slope, (sy - slope * sx) / n AS intercept FROM g)
SELECT c_mktsegment, CAST(n + step - 1 AS BIGINT) AS day_index,
       intercept + slope * CAST(n + step - 1 AS BIGINT) AS forecast
FROM h CROSS JOIN range(1, 8) AS r(step)""")
def q_forecast_linear_by_segment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"),
                      F.col("o_custkey") == F.col("c_custkey"), "inner")
    return forecast.forecast_linear(o, "o_orderdate", "o_totalprice", days_ahead=7,
                                    group_cols=["c_mktsegment"], value_scale=2)


@register("forecast_moving_average", sql=f"""
WITH d AS ({_DAILY_SQL}),
r AS (SELECT date, total, row_number() OVER (ORDER BY date DESC) AS rn FROM d),
l AS (SELECT max(date) AS last_date FROM d),
a AS (SELECT CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS forecast
      FROM r WHERE rn <= 7)
SELECT CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date,
       forecast
FROM l CROSS JOIN a CROSS JOIN range(1, 8) AS s(step)""")
def q_forecast_moving_average(spark, sf_dir):
    return forecast.forecast_moving_average(None, days_ahead=7, window=7,
                                            daily=_daily(spark, sf_dir), value_scale=2)


@register("forecast_naive", sql=f"""
WITH d AS ({_DAILY_SQL}),
l AS (SELECT max(date) AS last_date, arg_max(total, date) AS forecast FROM d)
SELECT CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date,
       forecast
FROM l CROSS JOIN range(1, 8) AS s(step)""")
def q_forecast_naive(spark, sf_dir):
    return forecast.forecast_naive(None, days_ahead=7, daily=_daily(spark, sf_dir))


@register("forecast_summary", sql=f"""
WITH fc AS ({_FORECAST_LINEAR_SQL})
SELECT count(*) AS n_steps, round(avg(forecast), 6) AS mean_forecast,
       round(sum(forecast), 6) AS total_forecast, round(max(forecast), 6) AS max_forecast,
       round(arg_min(forecast, day_index), 6) AS first_forecast
FROM fc""")
def q_forecast_summary(spark, sf_dir):
    s = forecast.forecast_summary(q_forecast_linear(spark, sf_dir))
    return s.select("n_steps", *[F.round(c, 6).alias(c) for c in
                                 ("mean_forecast", "total_forecast", "max_forecast",
                                  "first_forecast")])
