import datetime as dt
import itertools
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mercato.functions import scoring
from mercato.operators import churn, evaluate, runs


def _runs(spark, rows):
    return spark.createDataFrame(
        [(i, u, dt.datetime(2025, 10, d, h), s) for i, (u, d, h, s) in enumerate(rows)],
        "event_id long, upload_id long, created_at timestamp, status string")


def test_status_counts_keep_zeros_and_lookback(spark):
    df = _runs(spark, [(1, 1, 0, "started"), (1, 20, 0, "completed"), (2, 21, 0, "weird"),
                       (3, 30, 0, "completed")])
    got = {r["ui_status"]: r["runs"] for r in
           runs.status_counts(runs.recent(df, days=10)).collect()}
    assert got == {"Success": 2, "Failed": 0, "Running": 0}
    only = runs.recent(df, days=30, status="Running").count()
    assert only == 1


def test_status_by_day_and_latest(spark):
    df = _runs(spark, [(1, 1, 9, "started"), (1, 1, 10, "completed"), (2, 1, 10, "failed"),
                       (2, 2, 8, "foo")])
    by_day = {r["day"].day: (r["Success"], r["Failed"], r["Running"])
              for r in runs.status_by_day(df).collect()}
    assert by_day == {1: (1, 1, 1), 2: (0, 0, 0)}
    latest = {r["upload_id"]: r["status"] for r in
              runs.latest_per_key(df, ["upload_id"], "created_at", "event_id").collect()}
    assert latest == {1: "completed", 2: "foo"}
    top = [r["event_id"] for r in runs.newest(df, n=2, tie_col="event_id").collect()]
    assert top == [3, 2]


def test_features_fill_rules(spark):
    as_of = dt.datetime(2025, 1, 31, 12)
    rows = [("c1", 30.0, "Male", "Free", 400, dt.datetime(2024, 10, 1, 13), 2, 50.0, 25.0, 1),
            ("c2", None, None, None, None, None, None, None, None, 0),
            ("c3", 40.0, "Female", "Basic", 10, dt.datetime(2025, 1, 31, 13), 30, 300.0, 10.0, None)]
    df = spark.createDataFrame(rows, "customer_id string, age double, gender string, "
                               "segment string, subscription_length long, "
                               "last_login_date timestamp, total_orders long, total_spent double, "
                               "avg_order_value double, churned int")
    f = {r["customer_id"]: r for r in churn.churn_features(df, F.lit(as_of)).collect()}
    assert f["c2"]["age"] == 35.0 and f["c2"]["gender"] == "Unknown"
    assert f["c2"]["days_since_last_login"] == 365 and f["c2"]["total_orders"] == 0
    assert f["c1"]["days_since_last_login"] == 121   # time of day counts
    assert f["c3"]["days_since_last_login"] == -1
    levels = {"segment": ["Basic", "Free", "Unknown"]}
    unseen = spark.createDataFrame([("x", "Enterprise")], "customer_id string, segment string")
    oh = churn.one_hot(unseen, levels).first()
    assert (oh["segment_Basic"], oh["segment_Free"], oh["segment_Unknown"]) == (0, 0, 0)
    risk = {r["customer_id"]: (r["risk_points"], r["risk_probability"]) for r in
            churn.rule_churn_risk(churn.churn_features(df, F.lit(as_of))).collect()}
    assert risk["c1"] == (6, 0.8) and risk["c2"] == (4, 4 / 6)
    rates = churn.churn_rate_by(df, by=[]).first()
    assert (rates["customers"], rates["churned"], rates["churn_rate"]) == (2, 1, 50.0)


def test_labelled_gate(spark):
    rows = [(t, i, (i % 2) if t == 1 else None) for t in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "tenant_id long, customer_id long, churned int")
    g = {r["tenant_id"]: (r["labelled_rows"], r["eligible"]) for r in
         churn.labelled_counts(df).collect()}
    assert g == {1: (12, True), 2: (0, False)}
    assert churn.eligible_rows(df).count() == 12


def test_threshold_bucket_edges(spark):
    vals = [0.0, 0.0999, 0.1, 0.29, 0.2899999, 0.5, 0.89, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(scoring.threshold_bucket("s")).collect()]
    want = [max([j for j in range(10, 90) if v >= j / 100.0], default=9) for v in vals]
    assert got == want


def _brute(scores, labels):
    best = None
    out = []
    for j in range(10, 90):
        t = j / 100.0
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y != 1)
        fn = sum(1 for s, y in zip(scores, labels) if s < t and y == 1)
        f1 = 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
        out.append((t, tp, fp, fn, f1))
        if best is None or f1 > best[4]:
            best = out[-1]
    return out, best


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([i / 100 for i in range(0, 101)]),
                          st.integers(0, 1)), min_size=2, max_size=60))
def test_sweep_and_auc_match_brute_force(spark, pairs):
    scores, labels = zip(*pairs)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "score double, label int")
    sweep = {round(r["threshold"], 2): (r["tp"], r["fp"], r["fn"], r["f1"])
             for r in evaluate.threshold_sweep(df).collect()}
    want, best = _brute(scores, labels)
    for t, tp, fp, fn, f1 in want:
        assert sweep[round(t, 2)][:3] == (tp, fp, fn)
        assert abs(sweep[round(t, 2)][3] - f1) < 1e-12
    b = evaluate.best_threshold(evaluate.threshold_sweep(df)).first()
    assert abs(b["threshold"] - best[0]) < 1e-12
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    auc = evaluate.roc_auc(df).first()["auc"]
    if pos and neg:
        u = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
        assert abs(auc - u / (len(pos) * len(neg))) < 1e-12
    else:
        assert auc is None


def test_auc_many_distinct_scores(spark):
    rng = random.Random(3)
    pairs = [(rng.random(), rng.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "score double, label int")
    pos = sorted(s for s, y in pairs if y == 1)
    neg = sorted(s for s, y in pairs if y == 0)
    import bisect
    u = sum(bisect.bisect_left(neg, p) for p in pos)
    auc = evaluate.roc_auc(df, buckets=16).first()["auc"]
    assert abs(auc - u / (len(pos) * len(neg))) < 1e-12


def test_confusion_weights_and_labels(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.6, 0), (0.4, 1)], "score double, label int")
    c = evaluate.confusion(df, "score", "label", 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["accuracy"]) == (1, 1, 1, 1, 0.5)
    w = {r["label"]: r["weight"] for r in evaluate.class_weights(df).collect()}
    assert w == {1: 1.0, 0: 1.0}
    lab = df.select(scoring.risk_label("score", 0.5).alias("l"),
                    scoring.confidence("score").alias("c"),
                    scoring.display_tier("score").alias("t")).collect()
    assert [r["l"] for r in lab] == ["High Risk", "Low Risk", "Medium Risk", "Low Risk"]
    assert [round(r["c"], 9) for r in lab] == [0.8, 0.6, 0.2, 0.2]
    assert [r["t"] for r in lab] == ["high", "low", "medium", "low"]


def test_preview_latest_analysis_and_row_index(spark, tmp_path):
    from mercato.sources import sinks, tables
    df = spark.range(12).withColumn("g", (F.col("id") % 2).cast("int"))
    p = runs.preview(df, 3, [F.col("id").desc()], group_cols=["g"]).collect()
    assert sorted((r["g"], r["id"], r["more"]) for r in p) == [
        (0, 6, 3), (0, 8, 3), (0, 10, 3), (1, 7, 3), (1, 9, 3), (1, 11, 3)]
    top = runs.preview(df, 20, ["id"]).collect()
    assert len(top) == 12 and {r["more"] for r in top} == {0}
    a = spark.createDataFrame(
        [(1, '{"rows": 3}', dt.datetime(2025, 1, 1)), (1, '{"rows": 5}', dt.datetime(2025, 1, 2)),
         (2, '{"rows": 7}', dt.datetime(2025, 1, 1))],
        "upload_id long, summary_json string, created_at timestamp")
    got = {r["upload_id"]: r["summary"]["rows"] for r in
           sinks.latest_analysis(a, json_schemas={"summary": "rows long"}).collect()}
    assert got == {1: 5, 2: 7}
    assert sinks.latest_analysis(a, upload_id=2).count() == 1
    path = str(tmp_path / "t.parquet")
    spark.range(5).coalesce(1).write.parquet(path)
    idx = [r["row_index"] for r in tables.with_row_index(spark.read.parquet(path)).collect()]
    assert sorted(idx) == [0, 1, 2, 3, 4]
