import math

from pyspark.sql import functions as F

from conftest import ORDERS_ANOMALY, ORDERS_MISSING, ORDERS_SMALL
from mercato.operators import clean, roles
from mercato.plans import preprocess
from mercato.sources import uploads


def test_csv_upload_types_and_missing_tokens(spark, csv_file):
    d = csv_file("a,b,c,d,e\n1,1.5,x,true,NA\n2,,y,False,\n3,2.5,NULL,true,n/a\n")
    df = uploads.read_uploads(spark, d)
    t = dict(df.dtypes)
    assert (t["a"], t["b"], t["c"], t["d"], t["e"]) == ("bigint", "double", "string", "boolean",
                                                       "string")
    rows = df.orderBy("a").collect()
    assert rows[1]["b"] is None and rows[2]["c"] is None and rows[0]["e"] is None
    assert df.select("upload_id").distinct().count() == 1


def test_only_csv_files_are_uploads(spark, csv_file, tmp_path):
    d = csv_file(ORDERS_SMALL, "orders.CSV")
    (tmp_path / "u1" / "notes.txt").write_text("sku,quantity\nZ,1\n")
    df = uploads.read_uploads(spark, d)
    assert df.count() == 5
    m = uploads.ingest_manifest(spark, d, tenant_id=7).collect()
    assert [(r["filename"], r["status"], r["tenant_id"]) for r in m] == [("orders.CSV", "uploaded", 7)]
    assert m[0]["file_size"] == len(ORDERS_SMALL)


def test_clean_missing_mean_and_mode(spark, csv_file):
    df = uploads.read_uploads(spark, csv_file(ORDERS_MISSING)).drop("upload_file", "upload_id")
    out = clean.clean_missing(df).orderBy("sku").collect()
    assert out[1]["quantity"] == 18.75          # mean of 12, 18, 21, 24
    assert out[2]["price"] == 18.375            # mean of 8.5, 20, 14, 31
    assert out[3]["customer_id"] == "M3"        # mode, ties -> smallest
    assert out[4]["order_date"] == "2022-05-02"
    assert all(r[c] is not None for r in out for c in df.columns)


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a long, b string")
    out = clean.clean_missing(df).collect()
    assert [r["a"] for r in out] == [1.0, 1.0] and [r["b"] for r in out] == [None, None]


def test_grouped_imputation(spark):
    df = spark.createDataFrame([("u1", 1.0), ("u1", None), ("u2", 10.0), ("u2", None)],
                               "upload string, v double")
    out = {(r["upload"], r["v"]) for r in clean.clean_missing(df, ["upload"]).collect()}
    assert out == {("u1", 1.0), ("u2", 10.0)}


def test_parse_dates_and_enforce_numeric(spark):
    df = spark.createDataFrame([("2023-01-05", "1", "a", "1.5"), ("bad", "2", "3", "x")],
                               "order_date string, n string, m string, p string")
    out = clean.enforce_numeric(clean.parse_dates(df))
    t = dict(out.dtypes)
    assert t["order_date"] == "timestamp" and t["n"] == "bigint"
    assert t["m"] == "string" and t["p"] == "string"
    assert out.orderBy("n").collect()[1]["order_date"] is None


def test_role_detection(spark):
    cols = ["Customer ID", "Gender", "Age", "City", "Membership Type", "Total Spend",
            "Items Purchased", "Average Rating", "Discount Applied", "Days Since Last Purchase",
            "Satisfaction Level"]
    df = spark.createDataFrame([(101, "F", 30, "X", "Gold", 100.0, 3, 4.5, True, 9, "S")],
                               ", ".join(f"`{c}` {t}" for c, t in zip(cols, [
                                   "long", "string", "long", "string", "string", "double",
                                   "long", "double", "boolean", "long", "string"])))
    assert roles.find_date_column(df) is None
    assert roles.find_quantity_column(df) == "Total Spend"
    o = spark.createDataFrame([(1, "2023-01-01", 5.0)], "order_id long, created_on string, qty double")
    assert roles.find_date_column(o) == "order_id"            # substring "order" misfire
    assert roles.find_date_column(o, strict=True) == "created_on"
    v = spark.createDataFrame([(1.0, 100.0), (2.0, 300.0)], "a double, b double")
    assert roles.find_quantity_column(v) == "b"


def test_preprocess_small_upload_gates(spark, csv_file):
    df = uploads.read_uploads(spark, csv_file(ORDERS_ANOMALY)).drop("upload_file", "upload_id")
    res = preprocess.preprocess(df)
    doc = res.document().first()
    assert doc["record_count"] == 6 and doc["anomaly_count"] == 0   # < 10 rows
    assert len(doc["forecast"]) == 7 and all(math.isfinite(v) for v in doc["forecast"])
    assert set(doc["summary_stats"]) == {"sku", "quantity", "price", "customer_id", "order_date"}


def test_preprocess_missing_golden(spark, csv_file):
    df = uploads.read_uploads(spark, csv_file(ORDERS_MISSING)).drop("upload_file", "upload_id")
    res = preprocess.preprocess(df)
    assert res.date_col == "order_date" and res.quantity_col == "quantity"
    fc = res.document().first()["forecast"]
    assert [round(v, 9) for v in fc] == [12, 7.425, 2.85, -1.725, -6.3, -10.875, -15.45]


def test_preprocess_single_row_and_empty(spark, csv_file):
    one = uploads.read_uploads(spark, csv_file("sku,quantity,price,order_date\nurn,3,62.5,2022-08-09\n"))
    doc = preprocess.preprocess(one.drop("upload_file", "upload_id")).document().first()
    assert doc["record_count"] == 1 and doc["anomaly_count"] == 0 and doc["forecast"] == []
    empty = spark.createDataFrame([], "sku string, quantity double, order_date string")
    assert preprocess.preprocess(empty).document().count() == 0


def test_preprocess_many_uploads_at_once(spark, csv_file):
    a = uploads.read_uploads(spark, csv_file(ORDERS_SMALL))
    b = uploads.read_uploads(spark, csv_file(ORDERS_MISSING))
    both = a.unionByName(b).drop("upload_file")
    docs = {r["upload_id"]: r for r in preprocess.preprocess(both, ["upload_id"]).document().collect()}
    assert len(docs) == 2
    fcs = sorted(tuple(round(v, 6) for v in d["forecast"]) for d in docs.values())
    assert (27.0, 30.0, 33.0, 36.0, 39.0, 42.0, 45.0) in fcs
    assert all(d["record_count"] == 5 for d in docs.values())


def test_coercions(spark):
    from mercato.functions import lenient_number, lenient_number_or_zero, finite_or_zero
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string")
    out = df.select(lenient_number("s").alias("a"), lenient_number_or_zero("s").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in out] == [(1.5, 1.5), (None, 0.0), (None, 0.0)]
    f = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in f.select(finite_or_zero("x")).collect()] == [0.0, 0.0, 2.0]
    w = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t")  # a Monday
    from mercato.functions import weekday_mon0, days_elapsed
    r = w.select(weekday_mon0("t").alias("d"), days_elapsed(
        F.lit("2023-12-31 11:00:00").cast("timestamp"), "t").alias("e")).first()
    assert (r["d"], r["e"]) == (0, 0)
