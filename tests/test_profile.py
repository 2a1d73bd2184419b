import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st

from mercato.operators import profile, quantiles


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"q": [5.0, 3, 2, 1, 4, 6, 2, 1, 3, 5],
                        "s": ["a", "b", "a", "c", "b", "a", None, "c", "c", "a"]})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in profile.describe(df).collect()}
    want = pdf.describe(include="all")
    q = got["q"]
    assert q["count"] == 10 and q["kind"] == "numeric"
    for stat, col in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                      ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(q[stat] - want.loc[col, "q"]) < 1e-12, stat
    s = got["s"]
    assert (s["count"], s["unique"], s["top"], s["freq"]) == (9, 3, "a", 4)


def test_json_safe_and_summary(spark):
    df = spark.createDataFrame([(1.0, "x")], "v double, s string")
    p = {r["column"]: r for r in profile.json_safe(profile.describe(df)).collect()}
    assert p["v"]["std"] == 0.0 and p["s"]["mean"] == 0.0
    s = profile.dataset_summary(df, "missing").first()
    assert (s["rows"], s["column_count"], s["last_order_date"]) == (1, 2, None)


def test_modes_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    m = quantiles.column_modes(df, ["x"]).first()
    assert (m["top"], m["freq"], m["unique"], m["count"]) == ("a", 2, 3, 5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, width=32),
                min_size=1, max_size=300),
       st.sampled_from([4, 64]))
def test_exact_quantiles_match_numpy(spark, values, buckets):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in
           quantiles.exact_quantiles(df, ["x"], probs, buckets=buckets).collect()}
    want = np.quantile(np.array(values, dtype=float), probs)
    for p, w in zip(probs, want):
        assert abs(got[p] - w) <= 1e-9 * max(1.0, abs(w)), (p, got[p], w)


def test_grouped_exact_quantiles(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 7.0)] * 5
    df = spark.createDataFrame(rows, "g string, x double")
    out = {(r["g"], r["q"]): r["value"] for r in
           quantiles.exact_quantiles(df, ["x"], [0.5], group_cols=["g"]).collect()}
    assert out == {("a", 0.5): 50.0, ("b", 0.5): 7.0}


def test_variances_exact_and_plain(spark):
    df = spark.createDataFrame([(1.25,), (2.5,), (4.75,)], "x double")
    exact = profile.column_variances(df, scale=2).first()["variance"]
    plain = profile.column_variances(df).first()["variance"]
    assert abs(exact - np.var([1.25, 2.5, 4.75], ddof=1)) < 1e-12
    assert abs(exact - plain) < 1e-12


def test_approx_quantiles_close_to_exact(spark):
    rows = [(g, float(i % 997) * (1 if g == "a" else 3)) for g in ("a", "b") for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.75]
    ex = {(r["g"], r["q"]): r["value"] for r in
          quantiles.exact_quantiles(df, ["x"], probs, group_cols=["g"]).collect()}
    ap = {(r["g"], r["q"]): r["value"] for r in
          quantiles.approx_quantiles(df, ["x"], probs, group_cols=["g"]).collect()}
    assert set(ex) == set(ap)
    for k, v in ex.items():
        span = 997 * (1 if k[0] == "a" else 3)
        assert abs(ap[k] - v) <= 0.01 * span, (k, ap[k], v)


def test_describe_datetime_and_groups(spark):
    import datetime as dt
    rows = [(u, dt.datetime(2024, 1, 1 + i), float(i)) for u in ("u1", "u2") for i in range(5)]
    df = spark.createDataFrame(rows, "upload string, ts timestamp, v double")
    out = {(r["upload"], r["column"]): r for r in
           profile.describe(df, group_cols=["upload"]).collect()}
    ts = out[("u1", "ts")]
    assert ts["kind"] == "datetime" and ts["count"] == 5 and ts["std"] is None
    assert ts["p50"] == dt.datetime(2024, 1, 3).timestamp() * 1e6   # epoch microseconds (UTC)
    assert out[("u2", "v")]["p50"] == 2.0
