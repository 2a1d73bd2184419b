"""The preprocess flow over many uploads whose columns differ: every type,
fill, role, anomaly and forecast is the upload's own, all in the same jobs.

An upload without a date or quantity column, with too few rows, or without
values degrades to zero anomalies and an empty forecast; it never fails the
others.  A null upload id is an upload like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import finite_or_zero, lenient_number_or_zero, lenient_timestamp
from mercato.operators import anomaly, decisions as dec, forecast, series
from mercato.operators._util import null_safe_join, salted_join
from mercato.operators.profile import QUARTILES
from mercato.operators.quantiles import approx_quantiles, exact_quantiles, quantiles_wide
from mercato.plans.preprocess import MIN_ROWS_ANOMALY, MIN_ROWS_FORECAST
from mercato.session import written


def upload_series(rows: DataFrame, roles: DataFrame, fills: DataFrame, upload_col: str = "upload_id"
                  ) -> DataFrame:
    """(upload, date, total): the quantity column summed by the values of the
    date column, each upload's own; missing cells filled, dates that don't
    parse dropped, quantities that don't parse counted as zero."""
    def fill_of(role: str, prefix: str) -> DataFrame:
        return fills.select(upload_col, F.col("field").alias(role), F.col("mean").alias(f"{prefix}_mean"),
                            F.col("mode").alias(f"{prefix}_mode"))

    own = roles.where("date_column IS NOT NULL AND quantity_column IS NOT NULL")
    for role, prefix in (("date_column", "date"), ("quantity_column", "quantity")):
        own = null_safe_join(own, fill_of(role, prefix), [upload_col, role], "left", equal=[role])
    joined = salted_join(rows, own.drop("record_count", "column_count"), [upload_col])
    text = F.trim(F.col("cells")[F.col("quantity_column")])
    value = (F.when(F.col("quantity_kind").isin(*dec.NUMBERS),
                    F.coalesce(text.try_cast("double"), F.col("quantity_mean")))
             .otherwise(lenient_number_or_zero(F.coalesce(text, F.col("quantity_mode")))))
    day = lenient_timestamp(F.coalesce(F.trim(F.col("cells")[F.col("date_column")]),
                                       F.col("date_mode")))
    return series.daily_totals(joined.select(upload_col, day.alias("__day"), value.alias("__value")),
                               "__day", "__value", [upload_col], grain="raw")


def upload_summaries(cells: DataFrame, fills: DataFrame, upload_col: str = "upload_id",
                     exact: bool = True) -> DataFrame:
    """(upload, field, kind, count, unique, top, freq, mean, std, min, p25,
    p50, p75, max) after imputation, JSON-safe (no nulls but in ``top``)."""
    k = [upload_col, "field"]
    filled = salted_join(cells, fills, k).withColumn(
        "text", F.coalesce("text", F.when(~F.col("kind").isin(*dec.NUMBERS), F.col("mode"))))
    number = (F.when(F.col("kind").isin(*dec.NUMBERS),
                     F.coalesce(F.col("text").try_cast("double"), F.col("mean")))
              .when(F.col("kind") == "datetime",
                    F.unix_micros(lenient_timestamp("text")).cast("double")))
    numbers = filled.where(F.col("kind").isin(*dec.NUMBERS, "datetime")).select(
        *k, "kind", number.alias("value"))
    std = F.stddev_samp(F.when(F.col("kind") != "datetime", F.col("value")))
    moments = numbers.groupBy(*k, "kind").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), std.alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    points = (exact_quantiles if exact else approx_quantiles)(numbers, ["value"], QUARTILES, k)
    points = quantiles_wide(points, QUARTILES, ["p25", "p50", "p75"], k).drop("column")
    measured = null_safe_join(moments, points, k, "left", equal=["field"])
    counts = (filled.where(~F.col("kind").isin(*dec.NUMBERS, "datetime"))
              .groupBy(*k, "kind", "text").agg(F.count("text").alias("n")))
    texts = counts.groupBy(*k, "kind").agg(
        F.sum("n").alias("count"), F.count("text").alias("unique"),
        F.min_by("text", F.struct((-F.col("n")).alias("n"), "text")).alias("top"),
        F.max("n").alias("freq"))
    both = measured.unionByName(texts, allowMissingColumns=True)
    return both.select(
        *k, "kind", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                      for c in ("count", "unique", "freq")], "top",
        *[finite_or_zero(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def preprocess_uploads(rows: DataFrame, upload_col: str = "upload_id", strict: bool = True,
                       exact: bool = True) -> DataFrame:
    """One document for each upload of ``rows`` (upload, cells MAP<column,
    text>): record_count, column_count, date_column, quantity_column,
    anomaly_count, forecast ARRAY<DOUBLE>, summary_stats MAP<column, STRUCT>."""
    u = [upload_col]
    rows = written(rows.select(upload_col, "cells"))
    cells = dec.long_cells(rows, upload_col)
    decisions = written(dec.column_decisions(cells, upload_col))
    roles = written(dec.upload_roles(decisions, upload_col, strict))
    fills = written(dec.fill_table(cells, decisions, upload_col))
    daily = written(upload_series(rows, roles, fills, upload_col))
    odd = (anomaly.flag_series_anomalies(daily, "total", u)
           .groupBy(*u).agg(F.count(F.lit(1)).alias("odd_days")))
    long_enough = roles.where(F.col("record_count") >= MIN_ROWS_FORECAST).select(*u)
    ahead = forecast.forecast_linear(
        None, group_cols=u, daily=null_safe_join(daily, long_enough, u, "left_semi"))
    ahead = ahead.groupBy(*u).agg(F.array_sort(F.collect_list(F.struct(
        "day_index", finite_or_zero("forecast").alias("forecast")))).alias("ahead"))
    stats = upload_summaries(cells, fills, upload_col, exact)
    stats = stats.groupBy(*u).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(
        *[c for c in stats.columns if c not in (*u, "field")])))).alias("summary_stats"))
    doc = roles
    for part in (odd, ahead, stats):
        doc = null_safe_join(doc, part, u, "left")
    return doc.select(
        *u, "record_count", "column_count", "date_column", "quantity_column",
        F.when(F.col("record_count") >= MIN_ROWS_ANOMALY, F.coalesce("odd_days", F.lit(0)))
        .otherwise(0).cast("long").alias("anomaly_count"),
        F.coalesce(F.transform("ahead", lambda s: s["forecast"]),
                   F.array().cast("array<double>")).alias("forecast"), "summary_stats")
