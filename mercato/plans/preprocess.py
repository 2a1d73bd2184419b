"""Preprocess an upload: impute -> parse dates -> enforce numbers -> profile
-> find date / quantity columns -> daily anomalies (>= 10 rows) -> linear
forecast (>= 5 rows) -> JSON-safe document.

Works on many uploads at once: ``group_cols`` (e.g. the upload id) become
the grouping keys of every step, so imputation values, profiles, gates,
anomalies and forecasts are per upload, all in the same jobs.  Without
groups a constant key stands in for the single upload.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import finite_or_zero, lenient_number_or_zero
from mercato.operators import anomaly, clean, forecast, profile, roles, series
from mercato.operators._util import keys, null_safe_join
from mercato.session import materialize

# Minimum rows for the anomaly and forecast steps.
MIN_ROWS_ANOMALY = 10
MIN_ROWS_FORECAST = 5
_ONE = "__upload"


@dataclass
class PreprocessResult:
    data: DataFrame
    summary: DataFrame
    date_col: str | None
    quantity_col: str | None
    counts: DataFrame
    forecast: DataFrame | None
    group_cols: list

    def _public(self, df: DataFrame) -> DataFrame:
        return df.drop(_ONE) if _ONE in df.columns else df

    def document(self) -> DataFrame:
        """One row per upload: record_count, column_count, anomaly_count,
        forecast ARRAY<DOUBLE>, summary_stats MAP<column, STRUCT>."""
        g = self.group_cols
        stats = [c for c in self.summary.columns if c not in (*g, "column")]
        summ = self.summary.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct(
            "column", F.struct(*stats)))).alias("summary_stats"))
        doc = self.counts
        if self.forecast is not None:
            # at most days_ahead entries per upload
            fc = self.forecast.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct(
                "day_index", finite_or_zero("forecast").alias("forecast")))).alias("__fc"))
            doc = null_safe_join(doc, fc, g, "left").withColumn("forecast", F.coalesce(
                F.transform("__fc", lambda s: s["forecast"]),
                F.array().cast("array<double>"))).drop("__fc")
        else:
            doc = doc.withColumn("forecast", F.array().cast("array<double>"))
        doc = null_safe_join(doc, summ, g, "left")
        n_cols = len([c for c in self.data.columns if c not in g])
        return self._public(doc.select(*g, "record_count", F.lit(n_cols).alias("column_count"),
                                       "anomaly_count", "forecast", "summary_stats"))


def preprocess(df: DataFrame, group_cols: Sequence[str] = (), strict_roles: bool = False,
               exact_profile: bool = True) -> PreprocessResult:
    g = keys(group_cols)
    if not g:
        df, g = df.withColumn(_ONE, F.lit(0)), [_ONE]
    # the all-or-nothing numeric check runs on the raw rows (imputation only
    # fills with values a column already has, so it cannot change the
    # outcome); date-named strings are parsed as dates instead
    dated = {f.name for f in df.schema.fields
             if any(w in f.name.lower() for w in clean.DATE_NAME_WORDS)}
    conv = clean.numeric_string_columns(
        df, [c for c in df.columns if c not in g and c not in dated])
    data = clean.clean_missing(df, g)
    data = clean.parse_dates(data)
    data = clean.enforce_numeric(data, conv=conv)
    # the cleaned upload feeds the profile, both role detectors and the
    # series: write it once instead of re-running the imputation per reader
    data = materialize(data)
    summary = profile.json_safe(profile.describe(data, group_cols=g, exact=exact_profile))
    view = data.drop(*g)
    date_col = roles.find_date_column(view, strict=strict_roles)
    qty_col = roles.find_quantity_column(view, strict=strict_roles)
    counts = data.groupBy(*g).agg(F.count(F.lit(1)).alias("record_count"))
    fc = None
    if date_col and qty_col:
        typed = data.withColumn(qty_col, lenient_number_or_zero(qty_col))
        # the original groups on the raw value of the date column
        # read by the anomaly and the forecast branches: written once
        daily = materialize(series.daily_totals(typed, date_col, qty_col, g, grain="raw"))
        n_anom = (anomaly.flag_series_anomalies(daily, "total", g)
                  .groupBy(*g).agg(F.count(F.lit(1)).alias("__anom")))
        counts = (null_safe_join(counts, n_anom, g, "left")
                  .withColumn("anomaly_count", F.when(
                      F.col("record_count") >= MIN_ROWS_ANOMALY, F.coalesce("__anom", F.lit(0)))
                      .otherwise(F.lit(0)).cast("long")).drop("__anom"))
        eligible = counts.where(F.col("record_count") >= MIN_ROWS_FORECAST).select(*g)
        fc = forecast.forecast_linear(
            None, group_cols=g, daily=null_safe_join(daily, eligible, g, "left_semi"))
    else:
        counts = counts.withColumn("anomaly_count", F.lit(0).cast("long"))
    return PreprocessResult(data, summary, date_col, qty_col, counts, fc, g)
