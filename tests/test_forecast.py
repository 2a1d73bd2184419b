import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.operators import forecast


def _values(df, order="day_index"):
    return [r["forecast"] for r in df.orderBy(order).collect()]


def test_small_trend_golden(series_df):
    out = forecast.forecast_linear(series_df([10, 20, 30, 40, 50]))
    assert [round(v, 9) for v in _values(out)] == [60, 70, 80, 90, 100, 110, 120]
    assert [r["day_index"] for r in out.orderBy("day_index").collect()] == list(range(5, 12))


def test_up_and_down_trends(series_df):
    up = _values(forecast.forecast_linear(series_df([100, 110, 120, 130, 140])))
    down = _values(forecast.forecast_linear(series_df([140, 130, 120, 110, 100])))
    assert up[0] > 140 and down[0] < 100
    assert [round(v, 9) for v in _values(forecast.forecast_linear(
        series_df([140, 130, 120, 110, 100]), days_ahead=5))] == [90, 80, 70, 60, 50]


def test_constant_and_single(series_df):
    assert all(abs(v - 100) < 0.1 for v in _values(forecast.forecast_linear(series_df([100] * 5))))
    assert _values(forecast.forecast_linear(series_df([42]))) == [42.0] * 7


def test_negative_values_allowed(series_df):
    vals = _values(forecast.forecast_linear(series_df([100, -50, 150, -25, 200]), days_ahead=3))
    assert [round(v, 9) for v in vals] == [142.5, 165.0, 187.5]


@pytest.mark.parametrize("h", [1, 7, 14, 30])
def test_horizon(series_df, h):
    assert forecast.forecast_linear(series_df([1, 2, 3, 4, 5]), days_ahead=h).count() == h


def test_long_series_matches_numpy(series_df):
    rng = np.random.default_rng(7)
    vals = rng.normal(100, 10, 100).round(2).tolist()
    got = _values(forecast.forecast_linear(series_df(vals)))
    slope, icpt = np.polyfit(np.arange(100), vals, 1)
    want = [icpt + slope * i for i in range(100, 107)]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))


def test_empty_gives_no_rows(spark):
    empty = spark.createDataFrame([], "order_date timestamp, quantity double")
    assert forecast.forecast_linear(empty).count() == 0


def test_gaps_are_not_filled(spark):
    # observed days only: index 0, 1, 2 for 01-01, 01-05, 01-20
    rows = [("2023-01-01", 1.0), ("2023-01-05", 2.0), ("2023-01-20", 3.0)]
    df = spark.createDataFrame(rows, "order_date string, quantity double").withColumn(
        "order_date", F.to_timestamp("order_date"))
    assert [round(v, 9) for v in _values(forecast.forecast_linear(df, days_ahead=2))] == [4.0, 5.0]


def test_index_spans_years(spark):
    rows = [(f"{y}-12-3{d}", float(i)) for i, (y, d) in
            enumerate([(2020, 0), (2020, 1), (2021, 0), (2021, 1), (2022, 0)])]
    df = spark.createDataFrame(rows, "order_date string, quantity double").withColumn(
        "order_date", F.to_timestamp("order_date"))
    assert [round(v, 9) for v in _values(forecast.forecast_linear(df, days_ahead=2))] == [5.0, 6.0]


def test_moving_average_and_naive(series_df):
    df = series_df([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    ma = forecast.forecast_moving_average(df, window=7, days_ahead=3).orderBy("step").collect()
    assert [r["forecast"] for r in ma] == [7.0] * 3        # mean of 4..10
    assert [r["date"].isoformat() for r in ma] == ["2023-01-11", "2023-01-12", "2023-01-13"]
    nv = forecast.forecast_naive(df, days_ahead=2).orderBy("step").collect()
    assert [r["forecast"] for r in nv] == [10.0, 10.0]


def test_grouped_forecasts(series_df):
    a = series_df([10, 20, 30, 40, 50]).withColumn("g", F.lit("a"))
    b = series_df([5, 5, 5]).withColumn("g", F.lit("b"))
    out = forecast.forecast_linear(a.unionByName(b), days_ahead=1, group_cols=["g"])
    got = {r["g"]: round(r["forecast"], 9) for r in out.collect()}
    assert got == {"a": 60.0, "b": 5.0}


def test_summary(series_df):
    s = forecast.forecast_summary(forecast.forecast_linear(series_df([10, 20, 30, 40, 50]))).first()
    assert s["n_steps"] == 7 and round(s["first_forecast"], 9) == 60
    assert round(s["max_forecast"], 9) == 120 and round(s["total_forecast"], 6) == 630


def test_two_level_index_on_raw_timestamps(spark):
    import datetime as dt
    from mercato.operators import series
    from mercato.operators._util import ordered_index
    base = dt.datetime(2023, 12, 30, 22)
    rows = [("g1" if i % 3 else "g2", base + dt.timedelta(hours=5 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, date timestamp, total double")
    got = series.with_day_index(df, "date", ["g"], n_out="n").collect()
    for g in ("g1", "g2"):
        mine = sorted((r["date"], r["day_index"], r["n"]) for r in got if r["g"] == g)
        assert [i for _, i, _ in mine] == list(range(len(mine)))
        assert {n for _, _, n in mine} == {len(mine)}
    ties = spark.createDataFrame([(1, base, 3), (1, base, 1), (1, base, 2), (1, base.replace(hour=23), 0)],
                                 "t long, ts timestamp, id long")
    idx = sorted((r["id"], r["v"]) for r in
                 ordered_index(ties, "ts", ["t"], out="v", tie_cols=["id"]).collect())
    assert idx == [(0, 3), (1, 0), (2, 1), (3, 2)]
