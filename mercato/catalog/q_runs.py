"""Run-history queries.  The run log is derived from ``events``: upload =
user, run time = event time, status: signup -> started, purchase ->
completed, error -> failed, anything else kept as is (shown as Other)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import runs
from mercato.sources.tables import Tables

# Fixed mapping of the event types onto run statuses.
EVENT_STATUS = {"signup": "started", "purchase": "completed", "error": "failed"}

_RUNS_SQL = """
  SELECT event_id, user_id AS upload_id, ts AS created_at,
         CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' ELSE event_type END AS status
  FROM events"""

_UI_SQL = f"""
  SELECT *, coalesce(CASE status WHEN 'started' THEN 'Running' WHEN 'completed' THEN 'Success'
                                 WHEN 'failed' THEN 'Failed' END, 'Other') AS ui_status
  FROM ({_RUNS_SQL}) r"""

_RECENT_SQL = f"""
  SELECT * FROM ({_UI_SQL}) u
  WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"""


def run_log(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    m = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return ev.select("event_id", F.col("user_id").alias("upload_id"),
                     F.col("ts").alias("created_at"),
                     F.coalesce(m[F.col("event_type")], F.col("event_type")).alias("status"))


@register("run_status_counts", sql=f"""
WITH f AS ({_RECENT_SQL})
SELECT s.name AS ui_status, CAST(count(f.ui_status) AS BIGINT) AS runs
FROM (VALUES ('Success'), ('Failed'), ('Running')) s(name)
LEFT JOIN f ON f.ui_status = s.name GROUP BY s.name""")
def q_run_status_counts(spark, sf_dir):
    return runs.status_counts(runs.recent(run_log(spark, sf_dir), days=7))


@register("run_status_by_day", sql=f"""
SELECT CAST(created_at AS DATE) AS day,
       CAST(count_if(ui_status = 'Success') AS BIGINT) AS "Success",
       CAST(count_if(ui_status = 'Failed') AS BIGINT) AS "Failed",
       CAST(count_if(ui_status = 'Running') AS BIGINT) AS "Running"
FROM ({_RECENT_SQL}) f WHERE created_at IS NOT NULL GROUP BY 1""")
def q_run_status_by_day(spark, sf_dir):
    return runs.status_by_day(runs.recent(run_log(spark, sf_dir), days=7))


@register("recent_runs", sql=f"""
SELECT event_id, upload_id, created_at, status FROM ({_RUNS_SQL}) r
ORDER BY created_at DESC, event_id DESC LIMIT 10""")
def q_recent_runs(spark, sf_dir):
    return runs.newest(run_log(spark, sf_dir), "created_at", n=10, tie_col="event_id")


@register("latest_run_per_upload", sql=f"""
SELECT upload_id, event_id, created_at, status FROM (
  SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, event_id DESC)
         AS rn
  FROM ({_RUNS_SQL}) r) x
WHERE rn = 1""")
def q_latest_run_per_upload(spark, sf_dir):
    return runs.latest_per_key(run_log(spark, sf_dir), ["upload_id"], "created_at",
                               tie_col="event_id")


@register("anomaly_preview", sql="""
WITH s AS (
  SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std
  FROM events WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(*) >= 5),
o AS (
  SELECT e.event_type, e.event_id, e.value FROM events e JOIN s ON e.event_type = s.event_type
  WHERE e.value > s.mean + 3 * s.std OR e.value < s.mean - 3 * s.std),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)
             AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM o)
SELECT event_type, event_id, value, greatest(n - 5, 0) AS more FROM r WHERE rk <= 5""")
def q_anomaly_preview(spark, sf_dir):
    """The five largest price outliers of each item with the number not
    shown ("n more"), as a results page lists them."""
    from mercato.operators import anomaly
    ev = Tables(spark, sf_dir).events
    out = anomaly.item_price_outliers(ev, "event_type", "value", row_id_col="event_id")
    return runs.preview(out.select("event_type", "event_id", "value"), 5,
                        [F.col("value").desc(), F.col("event_id")], group_cols=["event_type"])
