"""Cleaning, type-coercion, profiling and column-role queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.functions.coerce import lenient_number, lenient_number_or_zero
from mercato.operators import clean, profile, roles
from mercato.plans import preprocess
from mercato.sources.tables import Tables

_PROFILE_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PROFILE_CAT = ("l_returnflag", "l_linestatus")


def _num_profile_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", 'numeric' AS kind, count({c}) AS count, CAST(0 AS BIGINT) AS "unique",
       CAST(NULL AS VARCHAR) AS top, CAST(0 AS BIGINT) AS freq,
       round(avg({c}), 6) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(max({c}), 6) AS max
FROM lineitem"""


def _cat_profile_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", 'categorical' AS kind,
       (SELECT count({c}) FROM lineitem) AS count,
       (SELECT count(DISTINCT {c}) FROM lineitem) AS "unique",
       (SELECT {c} FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS top,
       (SELECT count(*) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY count(*) DESC LIMIT 1) AS freq,
       0.0 AS mean, 0.0 AS std, 0.0 AS min, 0.0 AS p25, 0.0 AS p50, 0.0 AS p75, 0.0 AS max"""


@register("column_profile", headline=True, sql="\nUNION ALL\n".join(
    [_num_profile_sql(c) for c in _PROFILE_NUM] + [_cat_profile_sql(c) for c in _PROFILE_CAT]))
def q_column_profile(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    p = profile.json_safe(profile.describe(li, list(_PROFILE_NUM + _PROFILE_CAT), exact=True))
    return p.select("column", "kind", "count", "unique", "top", "freq",
                    *[F.round(c, 6).alias(c) for c in
                      ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _docs_with_gaps(t):
    d, lab = t.documents, t.labels
    return (d.join(lab, on="doc_id", how="left")
            .select("doc_id",
                    F.when(F.col("n_chars") < 500, F.lit(None)).otherwise(F.col("lang"))
                    .alias("lang"),
                    F.col("quality").cast("double").alias("quality"),
                    F.col("toxic").cast("double").alias("toxic")))


@register("impute_missing", sql="""
WITH j AS (
  SELECT d.doc_id, CASE WHEN d.n_chars < 500 THEN NULL ELSE d.lang END AS lang,
         CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT avg(quality) AS mq, avg(toxic) AS mt FROM j),
md AS (SELECT lang AS ml FROM j WHERE lang IS NOT NULL GROUP BY lang
       ORDER BY count(*) DESC, lang ASC LIMIT 1)
SELECT doc_id, coalesce(lang, ml) AS lang, coalesce(quality, mq) AS quality,
       coalesce(toxic, mt) AS toxic
FROM j CROSS JOIN m CROSS JOIN md""")
def q_impute_missing(spark, sf_dir):
    return clean.clean_missing(_docs_with_gaps(Tables(spark, sf_dir)),
                               cols=["lang", "quality", "toxic"])


def _mixed_price(t):
    return F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.col("o_totalprice").cast("string"))


@register("coerce_numeric", sql="""
SELECT o_orderkey,
       COALESCE(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), 0) AS priority_code,
       TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END
                AS DOUBLE) AS price_or_null,
       COALESCE(TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a'
                              ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE), 0) AS price_or_zero
FROM orders""")
def q_coerce_numeric(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    mixed = _mixed_price(o)
    return o.select("o_orderkey",
                    lenient_number_or_zero(F.substring_index("o_orderpriority", "-", 1))
                    .alias("priority_code"),
                    lenient_number(mixed).alias("price_or_null"),
                    lenient_number_or_zero(mixed).alias("price_or_zero"))


@register("enforce_numeric", sql="""
SELECT o_orderkey,
       CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS priority_code,
       split_part(o_orderpriority, '-', 2) AS priority_name,
       CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price,
       CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS mixed
FROM orders""")
def q_enforce_numeric(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    raw = o.select("o_orderkey",
                   F.substring_index("o_orderpriority", "-", 1).alias("priority_code"),
                   F.substring_index("o_orderpriority", "-", -1).alias("priority_name"),
                   F.col("o_totalprice").cast("string").alias("price"),
                   _mixed_price(o).alias("mixed"))
    return clean.enforce_numeric(raw)


@register("parse_dates", sql="""
SELECT o_orderkey,
       TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'not a date'
                     ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS order_date
FROM orders""")
def q_parse_dates(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    raw = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("not a date"))
                   .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"))
    out = clean.parse_dates(raw)
    return out.select("o_orderkey", F.col("order_date").cast("timestamp_ntz").alias("order_date"))


def _var_sql(c: str) -> str:
    x = f"CAST(round({c} * 100) AS HUGEINT)"
    return f"""
SELECT '{c}' AS "column",
       CAST(count({x}) * sum({x} * {x}) - sum({x}) * sum({x}) AS DOUBLE)
         / CAST(count({x}) * (count({x}) - 1) AS DOUBLE) / CAST(10000 AS DOUBLE) AS variance
FROM lineitem"""


@register("column_variance_rank", sql=f"""
WITH v AS ({" UNION ALL ".join(_var_sql(c) for c in _PROFILE_NUM)})
SELECT "column", variance, CAST(row_number() OVER (ORDER BY variance DESC, "column") AS INTEGER)
       AS variance_rank
FROM v""")
def q_column_variance_rank(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select(*_PROFILE_NUM)
    v = profile.column_variances(li, scale=2)
    # a handful of rows (one per column): ranking them needs no partitioning
    return v.withColumn("variance_rank", F.row_number().over(
        Window.orderBy(F.col("variance").desc(), F.col("column"))).cast("int"))


@register("detect_roles")
def q_detect_roles(spark, sf_dir):
    """Date and quantity column chosen for three shapes of the line items:
    as named, renamed to upload-style names, and with neutral names (where
    the highest-variance numeric column is chosen)."""
    li = Tables(spark, sf_dir).lineitem
    shapes = {
        "as_named": li,
        "upload_names": li.select(F.col("l_partkey").alias("sku"),
                                  F.col("l_quantity").alias("qty"),
                                  F.col("l_extendedprice").alias("unit_price"),
                                  F.col("l_shipdate").alias("shipped_on")),
        "neutral_names": li.select(F.col("l_partkey").alias("a"), F.col("l_quantity").alias("b"),
                                   F.col("l_extendedprice").alias("c"),
                                   F.col("l_shipdate").cast("string").alias("d")),
    }
    rows = [(k, roles.find_date_column(v), roles.find_quantity_column(v))
            for k, v in shapes.items()]
    return spark.createDataFrame(rows, "shape string, date_column string, quantity_column string")


@register("preprocess_document")
def q_preprocess_document(spark, sf_dir):
    """The full preprocess flow over orders, one upload per order status:
    imputation, date parsing, numeric enforcement, profile, role detection
    (strict: only date-like / numeric columns may match by name), 2-sigma
    daily anomaly count and 7-day linear forecast, as one document per
    upload."""
    o = Tables(spark, sf_dir).orders
    res = preprocess.preprocess(o, group_cols=["o_orderstatus"], strict_roles=True)
    return res.document()


@register("preprocess_counts", sql="""
WITH d AS (
  SELECT o_orderstatus, o_orderdate AS date, SUM(CAST(o_totalprice AS DOUBLE)) AS total
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY o_orderstatus, o_orderdate),
s AS (SELECT o_orderstatus, avg(total) AS m, stddev_samp(total) AS sd FROM d
      GROUP BY o_orderstatus),
a AS (SELECT d.o_orderstatus, count(*) AS n FROM d JOIN s ON d.o_orderstatus = s.o_orderstatus
      WHERE d.total > s.m + 2 * s.sd OR d.total < s.m - 2 * s.sd GROUP BY d.o_orderstatus),
r AS (SELECT o_orderstatus, count(*) AS record_count FROM orders GROUP BY o_orderstatus)
SELECT r.o_orderstatus, r.record_count, 5 AS column_count,
       CASE WHEN r.record_count >= 10 THEN coalesce(a.n, 0) ELSE 0 END AS anomaly_count
FROM r LEFT JOIN a ON r.o_orderstatus = a.o_orderstatus""")
def q_preprocess_counts(spark, sf_dir):
    """Record, column and 2-sigma anomaly-day counts of the preprocess
    document per upload (order status)."""
    return q_preprocess_document(spark, sf_dir).select(
        "o_orderstatus", "record_count", "column_count", "anomaly_count")
