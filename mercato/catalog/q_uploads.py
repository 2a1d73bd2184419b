"""Queries on uploads of different shapes: orders as three uploads (by
status) with other column names, one of them with a single bad number."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import decisions
from mercato.plans import preprocess_uploads
from mercato.sources.tables import Tables


def _uploads(spark, sf_dir):
    """(upload_id, cells): pending orders lack an upload id and any name
    that says what a column is."""
    o = Tables(spark, sf_dir).orders
    first = (o.where("o_orderstatus = 'O'").agg(F.min("o_orderkey").alias("first")))
    o = o.crossJoin(F.broadcast(first))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.col("o_totalprice").cast("string")
    gap = F.when(F.col("o_orderpriority") != "5-LOW", price)
    shapes = {
        "F": {"note": F.col("o_orderpriority"), "order_date": day, "amount": gap},
        "O": {"qty": F.when(F.col("o_orderkey") != F.col("first"), price).otherwise("bad"),
              "created": day, "code": F.col("o_custkey").cast("string")},
        "P": {"a": price, "b": day, "c": F.floor(F.col("o_totalprice") / 1000).cast("string"),
              "d": F.lit(None).cast("string")}}
    cells = F.lit(None).cast("map<string,string>")
    for status, columns in shapes.items():
        made = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c)])
        cells = F.when(F.col("o_orderstatus") == status, made).otherwise(cells)
    return o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
                    .alias("upload_id"), cells.alias("cells"))


_DATE_WORDS = ("date|time|created|order|timestamp|tarih|zaman|sipariş|registered|updated|modified")
_QUANTITY_WORDS = ("quantity|qty|amount|count|total|miktar|adet|sayı|tutar|price|fiyat|sales|satış")

_DECISION_SQL = f"""
o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice::VARCHAR AS price,
             min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER () AS first FROM orders),
cells AS (
  SELECT NULLIF(o_orderstatus, 'P') AS upload_id, o_orderkey AS row, unnest(CASE o_orderstatus
    WHEN 'F' THEN [{{'p': 0, 'f': 'note', 't': o_orderpriority}},
                   {{'p': 1, 'f': 'order_date', 't': day}},
                   {{'p': 2, 'f': 'amount',
                     't': CASE WHEN o_orderpriority <> '5-LOW' THEN price END}}]
    WHEN 'O' THEN [{{'p': 0, 'f': 'qty', 't': CASE WHEN o_orderkey <> first THEN price ELSE 'bad' END}},
                   {{'p': 1, 'f': 'created', 't': day}}, {{'p': 2, 'f': 'code', 't': o_custkey::VARCHAR}}]
    ELSE [{{'p': 0, 'f': 'a', 't': price}}, {{'p': 1, 'f': 'b', 't': day}},
          {{'p': 2, 'f': 'c', 't': floor(o_totalprice / 1000)::BIGINT::VARCHAR}},
          {{'p': 3, 'f': 'd', 't': NULL}}] END) AS c FROM o),
measured AS (
  SELECT upload_id, c.f AS field, min(c.p)::INTEGER AS place, count(*) AS rows, count(c.t) AS n,
         bool_and(c.t IS NULL OR regexp_full_match(c.t, '[+-]?\\d+')) AS longs,
         bool_and(c.t IS NULL OR try_cast(c.t AS DOUBLE) IS NOT NULL) AS doubles,
         count(try_cast(c.t AS TIMESTAMP)) AS dates, var_samp(try_cast(c.t AS DOUBLE)) AS variance,
         avg(try_cast(c.t AS DOUBLE)) AS mean
  FROM cells GROUP BY ALL),
decided AS (
  SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN regexp_matches(lower(field), 'date|tarih')
                 THEN 'datetime' WHEN longs THEN 'long' WHEN doubles THEN 'double'
                 ELSE 'string' END AS kind FROM measured),
ranked AS (
  SELECT *, kind = 'datetime' OR (kind = 'string' AND dates = n) AS date_like,
         kind IN ('long', 'double') AS number,
         CASE WHEN regexp_full_match(lower(trim(field)), '{_DATE_WORDS}') THEN 0
              WHEN regexp_matches(lower(field), '{_DATE_WORDS}') THEN 1 ELSE 2 END AS d,
         CASE WHEN regexp_full_match(lower(trim(field)), '{_QUANTITY_WORDS}') THEN 0
              WHEN regexp_matches(lower(field), '{_QUANTITY_WORDS}') THEN 1 ELSE 2 END AS q
  FROM decided),
roles AS (
  SELECT upload_id, max(rows) AS record_count, count(*) AS column_count,
         arg_min(field, (d, place)) FILTER (date_like) AS date_column,
         arg_min(field, (q, CASE WHEN q = 2 THEN -variance ELSE 0 END, place))
           FILTER (number AND (q < 2 OR variance IS NOT NULL)) AS quantity_column
  FROM ranked GROUP BY upload_id)"""


@register("upload_decisions", sql=f"""
WITH {_DECISION_SQL}
SELECT k.upload_id, field, place, rows, n, kind,
       CASE WHEN kind IN ('datetime', 'string') THEN dates / n::DOUBLE END AS parse_rate,
       round(CASE WHEN number THEN variance END, 2) AS variance,
       field = coalesce(date_column, '') AS is_date,
       field = coalesce(quantity_column, '') AS is_quantity
FROM ranked k JOIN roles r ON k.upload_id IS NOT DISTINCT FROM r.upload_id""")
def q_upload_decisions(spark, sf_dir):
    """Type, parse rate, variance and role of every column of every upload."""
    cells = decisions.long_cells(_uploads(spark, sf_dir))
    table = decisions.column_decisions(cells)
    roles = decisions.upload_roles(table).select(
        F.col("upload_id").alias("u"), "date_column", "quantity_column")
    return table.join(roles, F.col("upload_id").eqNullSafe(F.col("u"))).select(
        "upload_id", "field", "place", "rows", "n", "kind", "parse_rate",
        F.round("variance", 2).alias("variance"),
        (F.col("field") == F.coalesce("date_column", F.lit(""))).alias("is_date"),
        (F.col("field") == F.coalesce("quantity_column", F.lit(""))).alias("is_quantity"))


@register("preprocess_uploads", sql=f"""
WITH {_DECISION_SQL},
modes AS (
  SELECT upload_id, c.f AS field, arg_min(c.t, (-n, c.t)) AS mode FROM (
    SELECT upload_id, c, count(*) OVER (PARTITION BY upload_id, c.f, c.t) AS n FROM cells
    WHERE c.t IS NOT NULL) GROUP BY ALL),
picked AS (
  SELECT r.upload_id, x.row, max(CASE WHEN x.c.f = date_column THEN x.c.t END) AS day,
         max(CASE WHEN x.c.f = quantity_column THEN x.c.t END) AS q,
         any_value(date_column) AS date_column, any_value(quantity_column) AS quantity_column
  FROM cells x JOIN roles r ON x.upload_id IS NOT DISTINCT FROM r.upload_id
  WHERE date_column IS NOT NULL AND quantity_column IS NOT NULL GROUP BY ALL),
daily AS (
  SELECT p.upload_id, try_cast(coalesce(day, m.mode) AS TIMESTAMP) AS date,
         sum(coalesce(try_cast(q AS DOUBLE), k.mean)) AS total
  FROM picked p LEFT JOIN modes m ON m.upload_id IS NOT DISTINCT FROM p.upload_id
                                  AND m.field = p.date_column
  JOIN decided k ON k.upload_id IS NOT DISTINCT FROM p.upload_id AND k.field = p.quantity_column
  GROUP BY ALL HAVING date IS NOT NULL),
spread AS (SELECT upload_id, avg(total) AS m, stddev_samp(total) AS s FROM daily GROUP BY upload_id),
odd AS (
  SELECT d.upload_id, count(*) AS odd_days
  FROM daily d JOIN spread s ON d.upload_id IS NOT DISTINCT FROM s.upload_id
  WHERE abs(total - m) > 2 * s GROUP BY d.upload_id)
SELECT r.upload_id, record_count, column_count, date_column, quantity_column,
       CASE WHEN record_count >= 10 THEN coalesce(odd_days, 0) ELSE 0 END AS anomaly_count,
       7 AS forecast_days, column_count::INTEGER AS summaries
FROM roles r LEFT JOIN odd ON odd.upload_id IS NOT DISTINCT FROM r.upload_id""")
def q_preprocess_uploads(spark, sf_dir):
    """The preprocess document of every upload, by its own columns."""
    doc = preprocess_uploads.preprocess_uploads(_uploads(spark, sf_dir))
    return doc.select("upload_id", "record_count", "column_count", "date_column",
                      "quantity_column", "anomaly_count",
                      F.size("forecast").alias("forecast_days"),
                      F.size("summary_stats").alias("summaries"))
