import math
import statistics

from pyspark.sql import functions as F

from mercato.operators import anomaly, series


SPIKE = [52, 47, 55, 49, 51, 46, 54, 50, 48, 640]


def _dates(df):
    return sorted(r["date"].strftime("%Y-%m-%d") for r in df.collect())


def test_flat_series_has_no_anomalies(series_df):
    df = series_df(SPIKE[:5])
    assert anomaly.daily_anomalies(df).count() == 0
    assert series.daily_totals(df).count() == 5


def test_spike_is_found(series_df):
    df = series_df(SPIKE)
    out = anomaly.daily_anomalies(df)
    assert _dates(out) == ["2023-01-10"]
    r = out.first()
    assert math.isclose(r["mean"], statistics.mean(SPIKE))
    assert math.isclose(r["std"], statistics.stdev(SPIKE))


def test_empty_and_single_and_constant(spark, series_df):
    empty = spark.createDataFrame([], "order_date timestamp, quantity double")
    assert anomaly.daily_anomalies(empty).count() == 0
    assert anomaly.daily_anomalies(series_df([100])).count() == 0
    assert anomaly.daily_anomalies(series_df([100] * 5)).count() == 0


def test_trend_has_positive_std(series_df):
    daily = series.daily_totals(series_df([30, 60, 90, 120, 150]))
    st = anomaly.series_stats(daily).first()
    assert st["std"] > 0 and st["n_days"] == 5


def test_k_is_a_parameter_and_band_is_strict(series_df):
    df = series_df(SPIKE)
    assert anomaly.daily_anomalies(df, k=3.0).count() == 0  # 640 is within 3 deviations


def test_nulls_dropped_and_skipped(spark):
    rows = [("2023-01-01", 1.0), ("2023-01-01", None), (None, 5.0), ("2023-01-02", None)]
    df = spark.createDataFrame(rows, "order_date string, quantity double")
    d = {r["date"].isoformat(): r["total"] for r in series.daily_totals(df).collect()}
    assert d == {"2023-01-01": 1.0, "2023-01-02": 0.0}


def test_customer_value_outlier(spark):
    vals = [310, 295, 322, 304, 318, 299, 307, 313, 301, 9000]
    df = spark.createDataFrame([(chr(65 + i), v) for i, v in enumerate(vals)],
                               "customer_id string, `Total Spend` long")
    out = anomaly.row_anomalies(df, "Total Spend")
    assert [r["customer_id"] for r in out.collect()] == ["J"]
    assert anomaly.row_anomalies(df, "missing").count() == 0


def test_row_values_coerced(spark):
    df = spark.createDataFrame([(str(v),) for v in [1, 1, 1, 1, 1, 1, 1, 1, 1, 1]] + [("x",)],
                               "v string")
    # 'x' becomes 0 and is the only value off the band
    out = anomaly.row_anomalies(df, "v")
    assert [r["v"] for r in out.collect()] == [0.0]


def test_item_price_outliers_need_five_rows(spark):
    rows = [("A", i, 10.0) for i in range(20)] + [("A", 99, 1000.0)]
    rows += [("B", 100 + i, 10.0 if i < 3 else 500.0) for i in range(4)]   # only 4 rows
    df = spark.createDataFrame(rows, "sku string, row_id long, price double")
    out = anomaly.item_price_outliers(df, "sku", "price", row_id_col="row_id")
    assert [(r["sku"], r["row_id"], r["price"]) for r in out.collect()] == [("A", 99, 1000.0)]


def test_item_price_outliers_grouped(spark):
    rows = [(t, "A", i, 10.0) for t in (1, 2) for i in range(20)] + [(2, "A", 99, 999.0)]
    df = spark.createDataFrame(rows, "tenant long, sku string, row_id long, price double")
    out = anomaly.item_price_outliers(df, "sku", "price", "row_id", group_cols=["tenant"])
    assert [(r["tenant"], r["row_id"]) for r in out.collect()] == [(2, 99)]


def test_grouped_daily_anomalies_match_single(spark, series_df):
    vals = SPIKE
    a = series_df(vals).withColumn("g", F.lit("x"))
    b = series_df([5] * 10).withColumn("g", F.lit("y"))
    out = anomaly.daily_anomalies(a.unionByName(b), group_cols=["g"])
    assert [(r["g"], r["date"].day) for r in out.collect()] == [("x", 10)]
