"""Demand feature and scoring queries on line items (sku = part, quantity,
price = extended price, date = ship date)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.operators import demand, encode
from mercato.sources.tables import Tables


def _lines(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("sku"),
                     F.col("l_quantity").alias("quantity"),
                     F.col("l_extendedprice").alias("price"),
                     F.col("l_shipdate").alias("order_date"))


def _line_key():
    return F.concat_ws(":", "l_orderkey", "l_linenumber")


@register("demand_features", sql="""
SELECT l_orderkey, l_linenumber,
       COALESCE(TRY_CAST(l_quantity AS DOUBLE), 0) AS quantity,
       COALESCE(TRY_CAST(l_extendedprice AS DOUBLE), 0) AS price,
       COALESCE(CAST(month(l_shipdate) AS INTEGER), 0) AS month,
       COALESCE(CAST(isodow(l_shipdate) - 1 AS INTEGER), 0) AS day_of_week,
       COALESCE(CAST(dayofyear(l_shipdate) AS INTEGER), 0) AS day_of_year
FROM lineitem""")
def q_demand_features(spark, sf_dir):
    return demand.demand_features(_lines(spark, sf_dir), keep=["l_orderkey", "l_linenumber"])


@register("demand_score")
def q_demand_score(spark, sf_dir):
    """Fit the quantity regressor (price + calendar + out-of-fold mean of the
    part) on the line items and score every line."""
    lines = _lines(spark, sf_dir)
    feats = demand.demand_features(lines, keep=["l_orderkey", "l_linenumber", "sku"])
    model = demand.train_demand(feats, item_col="sku", key=_line_key())
    return demand.score_demand(model, feats, keep=["l_orderkey", "l_linenumber", "sku"])


@register("item_demand_means", sql="""
WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS sku, l_quantity::DOUBLE AS quantity,
         ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 7))::BIGINT % 5 AS fold
  FROM lineitem),
f AS (SELECT sku, fold, sum(quantity) AS s, count(*) AS n FROM l GROUP BY sku, fold),
t AS (SELECT sku, sum(quantity) AS s, count(*) AS n FROM l GROUP BY sku),
o AS (SELECT avg(quantity) AS overall FROM l)
SELECT l_orderkey, l_linenumber, l.sku, l.fold,
       CASE WHEN t.n > f.n THEN (t.s - f.s) / (t.n - f.n) ELSE overall END AS item_mean
FROM l JOIN f ON l.sku = f.sku AND l.fold = f.fold JOIN t ON l.sku = t.sku CROSS JOIN o""")
def q_item_demand_means(spark, sf_dir):
    """The out-of-fold mean quantity of the part of every line."""
    lines = encode.with_out_of_fold_means(_lines(spark, sf_dir), "sku", "quantity", _line_key())
    return lines.select("l_orderkey", "l_linenumber", "sku", "fold", "item_mean")


@register("encoded_levels", sql="""
WITH c AS (
  SELECT 'part' AS "column", l_partkey::VARCHAR AS value FROM lineitem UNION ALL
  SELECT 'flag', l_returnflag FROM lineitem UNION ALL
  SELECT 'day', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)
SELECT "column", value, count(*) AS rows, count(*) AS encoded,
       row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS index
FROM c WHERE value IS NOT NULL GROUP BY "column", value""")
def q_encoded_levels(spark, sf_dir):
    """Every level of three columns of the line items (parts and days among
    them) with its index and the rows that are encoded with it."""
    li = Tables(spark, sf_dir).lineitem.select(
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    names = ["part", "flag", "day"]
    levels = encode.level_table(li, names)
    rows = encode.encode(li, levels, encode.level_counts(levels))
    seen = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_index").cast("long").alias("index"))
        for c in names])).alias("s")).groupBy("s.column", "s.index").agg(F.count("*").alias("encoded"))
    return levels.join(seen, ["column", "index"])
