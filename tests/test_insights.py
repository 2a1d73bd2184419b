from conftest import SAMPLE_ORDERS
from mercato.operators import insights
from mercato.plans import insights_doc
from mercato.sources import uploads


def _orders(spark, csv_file, text=SAMPLE_ORDERS):
    return uploads.read_uploads(spark, csv_file(text)).drop("upload_file", "upload_id")


def test_sample_orders_insights(spark, csv_file):
    df = _orders(spark, csv_file)
    res = insights_doc.insights(df)
    doc = res.document.first()
    assert doc["summary"]["rows"] == 7
    assert doc["summary"]["last_order_date"] == "2021-11-11"
    assert dict(doc["insights"]["top_skus"]) == {"TEA": 20.0, "NUT": 14.0, "OIL": 7.0}
    assert doc["insights"]["churn_at_risk_count"] == 0
    assert doc["insights"]["anomaly_count"] == 0
    assert res.price_outliers.count() == 0        # every SKU has < 5 rows


def test_top_items_ties_and_bad_quantities(spark):
    df = spark.createDataFrame([("b", "2"), ("a", "2"), ("c", "x"), ("d", "1")],
                               "sku string, quantity string")
    out = [(r["sku"], r["total_quantity"]) for r in insights.top_items(df, n=3).collect()]
    assert out == [("a", 2.0), ("b", 2.0), ("d", 1.0)]


def test_top_items_per_group(spark):
    rows = [(g, s, q) for g in ("u1", "u2") for s, q in (("a", 1), ("b", 5), ("c", 3))]
    df = spark.createDataFrame(rows, "upload string, sku string, quantity long")
    out = insights.top_items(df, n=2, group_cols=["upload"]).collect()
    assert sorted((r["upload"], r["sku"], r["rank"]) for r in out) == [
        ("u1", "b", 1), ("u1", "c", 2), ("u2", "b", 1), ("u2", "c", 2)]


def test_customers_at_risk_strict_and_nulls(spark):
    rows = [("A", "2024-01-01"), ("A", "2024-06-01"), ("B", "2024-03-03"), ("C", "2024-03-04"),
            ("D", "not a date"), (None, "2024-01-01")]
    df = spark.createDataFrame(rows, "customer_id string, order_date string")
    # latest 2024-06-01, cutoff 2024-03-03: B is not strictly before, C is after
    assert insights.customers_at_risk(df).count() == 0
    rows.append(("E", "2024-03-02"))
    df = spark.createDataFrame(rows, "customer_id string, order_date string")
    assert [r["customer_id"] for r in insights.customers_at_risk(df).collect()] == ["E"]
    assert insights.customers_at_risk_count(df).first()["churn_at_risk_count"] == 1


def test_missing_columns_skip_insights(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    doc = insights_doc.insights(df).document.first()
    assert doc["summary"]["rows"] == 1 and doc["insights"] is not None
    assert "top_skus" not in doc["insights"].asDict()
