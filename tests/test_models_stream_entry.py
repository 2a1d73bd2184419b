import datetime as dt
import os
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from mercato.operators import churn_model, demand
from mercato.session import scratch_path
from mercato.streaming import ingest


def _customers(spark, n=300, seed=5):
    rng = random.Random(seed)
    as_of = dt.datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        inactive = rng.randint(1, 180)
        orders = rng.randint(0, 50)
        seg = rng.choice(["Basic", "Premium", "Free"])
        churned = 1 if (inactive > 90) or (orders < 3 and rng.random() < 0.8) else 0
        rows.append((f"C{i:04d}", rng.randint(18, 65), rng.choice(["Male", "Female"]), seg,
                     rng.randint(30, 1095), as_of - dt.timedelta(days=inactive), orders,
                     orders * 20.0, 20.0, churned))
    return spark.createDataFrame(rows, "customer_id string, age int, gender string, "
                                 "segment string, subscription_length int, "
                                 "last_login_date timestamp, total_orders int, "
                                 "total_spent double, avg_order_value double, churned int"), as_of


def test_churn_model_train_register_score(spark):
    df, as_of = _customers(spark)
    m = churn_model.train_churn_model(df, F.lit(as_of), gbt_params={"maxIter": 15})
    assert m.metrics["auc"] > 0.8
    assert 0.1 <= m.threshold <= 0.89 and set(m.feature_importance) >= set(m.features) - {"gender", "segment"}
    store = scratch_path(spark, "test-models")
    churn_model.register_model(spark, m, store, tenant_id=3)
    churn_model.register_model(spark, m, store, tenant_id=3)
    act = churn_model.active_models(churn_model.registry(spark, store)).collect()
    assert [(r["tenant_id"], r["version"], r["tenant_rows"]) for r in act] == [(3, 2, 300)]
    loaded = churn_model.load_active(spark, store, 3)
    new = spark.createDataFrame([("Z", None, "Other", "Enterprise", None, None, None, None, None)],
                                "customer_id string, age int, gender string, segment string, "
                                "subscription_length int, last_login_date timestamp, "
                                "total_orders int, total_spent double, avg_order_value double")
    s = churn_model.score_churn(loaded, new, F.lit(as_of)).first()
    assert 0.0 <= s["churn_probability"] <= 1.0 and 0.1 <= s["confidence"] <= 0.9
    assert s["prediction"] in ("High Risk", "Medium Risk", "Low Risk")
    assert churn_model.load_active(spark, store, 99) is None


def test_demand_features_and_model(spark):
    rows = [(f"S{i % 3}", float(1 + i % 5), 10.0 + i % 7, dt.datetime(2024, 1, 1) +
             dt.timedelta(days=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "sku string, quantity double, price double, "
                               "order_date timestamp")
    f = demand.demand_features(df, keep=["sku"])
    first = f.orderBy("day_of_year").first()
    assert (first["month"], first["day_of_week"], first["day_of_year"]) == (1, 0, 1)
    model = demand.train_demand(f, item_col="sku")
    out = demand.score_demand(model, f, keep=["sku"])
    assert out.where(F.col("predicted_quantity").isNull()).count() == 0
    unseen = demand.demand_features(spark.createDataFrame(
        [("NEW", "x", None, "2024-02-01")], "sku string, quantity string, price double, "
        "order_date string"), keep=["sku"])
    assert demand.score_demand(model, unseen).count() == 1


def test_stream_sees_each_file_once(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    st = "sku string, quantity double, price double, customer_id string, order_date string"

    def analyse(batch):
        return batch.groupBy("upload_id").agg(F.count(F.lit(1)).alias("rows"),
                                              F.sum("quantity").alias("qty"))

    def run():
        q = ingest.run_ingest(ingest.upload_stream(spark, str(src)), out, ckpt, analyse,
                              bind=ingest.by_header(st))
        q.awaitTermination()

    (src / "a.csv").write_text("sku,quantity,price,customer_id,order_date\nA,1,1.0,C,2024-01-01\n")
    (src / "skip.txt").write_text("not an upload")
    run()
    (src / "b.csv").write_text("sku,quantity,price,customer_id,order_date\nB,2,1.0,C,2024-01-02\n"
                               "B,3,1.0,C,2024-01-03\n")
    run()
    run()   # nothing new
    res = spark.read.parquet(os.path.join(out, "analyses"))
    assert sorted(r["rows"] for r in res.collect()) == [1, 2]
    runs = spark.read.parquet(os.path.join(out, "pipeline_runs"))
    assert sorted(r["status"] for r in runs.collect()) == ["completed", "completed",
                                                          "started", "started"]


def test_stream_upload_insights_per_upload(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = ["sku,quantity,price,customer_id,order_date"]
    lines += [f"S{i % 2},{i},{10.0 + (i % 3)},C{i % 4},2024-01-{1 + i:02d}" for i in range(12)]
    (src / "u1.csv").write_text("\n".join(lines) + "\n")
    (src / "u2.csv").write_text("sku,quantity,price,customer_id,order_date\nZ,5,1.0,C9,2024-02-01\n")
    schema = "sku string, quantity double, price double, customer_id string, order_date string"
    q = ingest.run_ingest(ingest.upload_stream(spark, str(src)), str(tmp_path / "o"),
                          str(tmp_path / "c"), ingest.upload_insights,
                          bind=ingest.by_header(schema))
    q.awaitTermination()
    res = {r["upload_id"]: r for r in spark.read.parquet(str(tmp_path / "o" / "analyses")).collect()}
    by_rows = sorted((r["rows"], dict(r["top_skus"])) for r in res.values())
    assert by_rows == [(1, {"Z": 5.0}), (12, {"S1": 36.0, "S0": 30.0})]


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["date", "total", "direction"]
    assert df.count() >= 0
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40
    for name in ("top_items", "run_status_counts", "threshold_sweep"):
        assert qs[name](spark, SF_SMALL).count() > 0


def test_train_for_tenant_gate(spark):
    df, as_of = _customers(spark, n=60)
    df = df.withColumn("tenant_id", F.when(F.col("customer_id") < "C0005", 2).otherwise(1))
    store = scratch_path(spark, "test-tenant-models")
    small = churn_model.train_for_tenant(spark, df, 2, F.lit(as_of), store)
    assert small["success"] is False and small["labelled_rows"] == 5
    ok = churn_model.train_for_tenant(spark, df, 1, F.lit(as_of), store,
                                      gbt_params={"maxIter": 5})
    assert ok["success"] and ok["version"] == 1
