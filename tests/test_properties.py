"""Property tests (random daily series) for the anomaly and forecast operators."""

import math

from hypothesis import given, settings, strategies as st

from mercato.operators import anomaly, forecast, series

values = st.lists(st.floats(min_value=0, max_value=1000, allow_nan=False, allow_infinity=False),
                  min_size=1, max_size=60)


@settings(max_examples=10, deadline=None)
@given(values)
def test_anomalies_are_days_strictly_outside_the_band(series_df, vals):
    df = series_df(vals)
    daily = {r["date"]: r["total"] for r in series.daily_totals(df).collect()}
    out = anomaly.daily_anomalies(df).collect()
    assert len(daily) == len(vals) and len(out) <= len(daily)
    n = len(vals)
    if n < 2:
        assert out == []
        return
    mean = sum(vals) / n
    std = math.sqrt(sum((v - mean) ** 2 for v in vals) / (n - 1))
    for r in out:
        assert r["date"] in daily and daily[r["date"]] == r["total"]
        assert abs(r["total"] - mean) > 2 * std - 1e-6 * max(1.0, abs(mean))
    flagged = {r["date"] for r in out}
    for d, v in daily.items():
        if abs(v - mean) > 2 * std + 1e-6 * max(1.0, abs(mean)):
            assert d in flagged


@settings(max_examples=10, deadline=None)
@given(values, st.integers(min_value=1, max_value=30))
def test_forecast_has_horizon_finite_values(series_df, vals, h):
    out = forecast.forecast_linear(series_df(vals), days_ahead=h).collect()
    assert len(out) == h
    assert all(math.isfinite(r["forecast"]) for r in out)
    assert sorted(r["day_index"] for r in out) == list(range(len(vals), len(vals) + h))


@settings(max_examples=6, deadline=None)
@given(values)
def test_flat_forecasts_equal_their_definition(series_df, vals):
    df = series_df(vals)
    ma = forecast.forecast_moving_average(df, days_ahead=3).collect()
    tail = vals[-7:]
    assert all(abs(r["forecast"] - sum(tail) / len(tail)) < 1e-9 * max(1.0, max(tail)) for r in ma)
    nv = forecast.forecast_naive(df, days_ahead=2).collect()
    assert all(r["forecast"] == vals[-1] for r in nv)
