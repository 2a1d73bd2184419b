"""Churn queries over a customer table derived from customer + orders.

Mapping onto the reference customer schema: tenant_id = c_nationkey,
customer_id = c_custkey, age = c_acctbal (negative balances read as
missing), gender = region name, segment = c_mktsegment.  Activity comes
from orders up to a feature date 180 days before the latest order:
last_login_date = last order, subscription_length = days since the first
order, total_orders / total_spent / avg_order_value from those orders.
Label: churned = 1 when the customer has history but no order after the
feature date, 0 when they ordered again, NULL without history.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.functions.coerce import days_elapsed
from mercato.functions.scoring import confidence, display_tier, risk_label
from mercato.operators import churn, evaluate, split
from mercato.operators._util import attach_group_stats
from mercato.sources import sinks
from mercato.sources.tables import Tables

HORIZON_DAYS = 180
FREE_SEGMENT = "HOUSEHOLD"   # plays the role of the free tier in the rule score
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def customer_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice")
    ref = o.agg((F.max("o_orderdate") - F.make_interval(days=F.lit(HORIZON_DAYS)))
                .alias("feature_date"))
    o = attach_group_stats(o, ref, [])
    past = F.col("o_orderdate") <= F.col("feature_date")
    # one pass over the orders: history and return from conditional aggregates
    hist = o.groupBy(F.col("o_custkey").alias("h_custkey")).agg(
        F.min(F.when(past, F.col("o_orderdate"))).alias("first_order"),
        F.max(F.when(past, F.col("o_orderdate"))).alias("last_order"),
        F.nullif(F.count_if(past), F.lit(0)).alias("total_orders"),
        F.sum(F.when(past, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
        .alias("total_spent"),
        F.bool_or(F.col("o_orderdate") > F.col("feature_date")).alias("ordered_again"))
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner")
           .select("n_nationkey", "r_name"))
    c = (t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(hist, F.col("c_custkey") == F.col("h_custkey"), "left"))
    c = attach_group_stats(c, ref, [])
    return c.select(
        F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("age"),
        F.col("r_name").alias("gender"), F.col("c_mktsegment").alias("segment"),
        days_elapsed(F.col("first_order"), F.col("feature_date")).alias("subscription_length"),
        F.col("last_order").alias("last_login_date"),
        "total_orders", "total_spent",
        F.try_divide(F.col("total_spent"), F.col("total_orders")).alias("avg_order_value"),
        F.when(F.col("total_orders").isNull(), F.lit(None).cast("int"))
        .when(F.col("ordered_again"), F.lit(0)).otherwise(F.lit(1)).alias("churned"),
        "feature_date")


def _ages(spark, sf_dir):
    """The ``age`` column alone, read from the customer table (one row per
    customer, like the derived table, so the median is the same)."""
    c = Tables(spark, sf_dir).customer
    return c.select(F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal"))
                    .alias("age"))


def customer_features(spark, sf_dir):
    c = customer_table(spark, sf_dir)
    # the median needs only the balances: no orders joins in that job
    medians = churn.median_table(_ages(spark, sf_dir), ["age"])
    return churn.churn_features(c, F.col("feature_date"), medians=medians)


_CUSTOMER_SQL = f"""
  WITH ref AS (SELECT max(o_orderdate) - INTERVAL {HORIZON_DAYS} DAY AS feature_date FROM orders),
  hist AS (
    SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
           count(*) AS total_orders,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent
    FROM orders, ref WHERE o_orderdate <= feature_date GROUP BY o_custkey),
  again AS (SELECT DISTINCT o_custkey FROM orders, ref WHERE o_orderdate > feature_date),
  base AS (
    SELECT c.c_nationkey AS tenant_id, c.c_custkey,
           CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS age,
           r.r_name AS gender, c.c_mktsegment AS segment,
           CAST(floor((epoch_us(CAST(ref.feature_date AS TIMESTAMP))
                       - epoch_us(CAST(h.first_order AS TIMESTAMP))) / 86400000000) AS BIGINT)
             AS subscription_length,
           h.last_order AS last_login_date, h.total_orders, h.total_spent,
           h.total_spent / h.total_orders AS avg_order_value,
           CASE WHEN h.o_custkey IS NULL THEN NULL WHEN a.o_custkey IS NOT NULL THEN 0 ELSE 1 END
             AS churned,
           ref.feature_date
    FROM customer c
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN hist h ON c.c_custkey = h.o_custkey
    LEFT JOIN again a ON c.c_custkey = a.o_custkey
    CROSS JOIN ref),
  med AS (SELECT median(age) AS m_age FROM base),
  feat AS (
    SELECT tenant_id, c_custkey, coalesce(age, m_age) AS age, coalesce(gender, 'Unknown') AS gender,
           coalesce(segment, 'Unknown') AS segment,
           coalesce(subscription_length, 0) AS subscription_length,
           coalesce(CAST(floor((epoch_us(CAST(feature_date AS TIMESTAMP))
                                - epoch_us(CAST(last_login_date AS TIMESTAMP))) / 86400000000)
                         AS BIGINT), 365) AS days_since_last_login,
           coalesce(total_orders, 0) AS total_orders, coalesce(total_spent, 0) AS total_spent,
           coalesce(avg_order_value, 0) AS avg_order_value, churned
    FROM base CROSS JOIN med)"""

_FEATURE_COLS = ("c_custkey", "age", "subscription_length", "days_since_last_login",
                 "total_orders", "total_spent", "avg_order_value", "gender", "segment", "churned")


@register("customer_features", sql=f"""{_CUSTOMER_SQL}
SELECT {", ".join(_FEATURE_COLS)} FROM feat""")
def q_customer_features(spark, sf_dir):
    f = customer_features(spark, sf_dir)
    return f.select(*_FEATURE_COLS)


def _onehot_sql(col: str, levels) -> str:
    return ", ".join(f"CAST({col} = '{v}' AS INTEGER) AS \"{col}_{v}\"" for v in levels)


@register("customer_features_onehot", sql=f"""{_CUSTOMER_SQL}
SELECT c_custkey, {_onehot_sql("gender", REGIONS)}, {_onehot_sql("segment", SEGMENTS)}
FROM feat""")
def q_customer_features_onehot(spark, sf_dir):
    f = customer_features(spark, sf_dir)
    levels = {"gender": REGIONS, "segment": SEGMENTS}
    return churn.one_hot(f, levels).select(
        "c_custkey", *[f"`{c}_{v}`" for c, vals in levels.items() for v in vals])


@register("rule_churn_risk", sql=f"""{_CUSTOMER_SQL}
SELECT c_custkey, points AS risk_points,
       least(CAST(points AS DOUBLE) / CAST(6 AS DOUBLE), CAST(0.8 AS DOUBLE)) AS risk_probability
FROM (SELECT c_custkey, CAST(
        (CASE WHEN days_since_last_login > 90 THEN 2 ELSE 0 END)
      + (CASE WHEN total_orders < 3 THEN 2 ELSE 0 END)
      + (CASE WHEN segment = '{FREE_SEGMENT}' THEN 1 ELSE 0 END)
      + (CASE WHEN subscription_length > 365 AND total_orders < 10 THEN 1 ELSE 0 END)
      AS INTEGER) AS points FROM feat) p""")
def q_rule_churn_risk(spark, sf_dir):
    # the rule reads no median
    f = churn.churn_features(customer_table(spark, sf_dir), F.col("feature_date"), median_cols=())
    return churn.rule_churn_risk(f, free_segment=FREE_SEGMENT).select(
        "c_custkey", "risk_points", "risk_probability")


@register("churn_rate_by_segment", sql=f"""{_CUSTOMER_SQL}
SELECT segment, count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned,
       CAST(sum(churned) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS churn_rate
FROM feat WHERE churned IS NOT NULL GROUP BY segment""")
def q_churn_rate_by_segment(spark, sf_dir):
    return churn.churn_rate_by(customer_table(spark, sf_dir), "churned", ["segment"])


@register("churn_rate_by_tenant_segment", sql=f"""{_CUSTOMER_SQL}
SELECT tenant_id, segment, subscription_length > 2000 AS long_term, count(churned) AS customers,
       CAST(coalesce(sum(churned), 0) AS BIGINT) AS churned,
       coalesce(CAST(sum(churned) AS DOUBLE) / nullif(CAST(count(churned) AS DOUBLE), 0) * 100.0, 0)
         AS churn_rate
FROM feat GROUP BY ALL""")
def q_churn_rate_by_tenant_segment(spark, sf_dir):
    """Rates of small segments, some of which have no labelled customer."""
    c = customer_table(spark, sf_dir).withColumns({
        "segment": F.coalesce("segment", F.lit(churn.UNKNOWN)),
        "long_term": F.coalesce("subscription_length", F.lit(0)) > 2000})
    return churn.churn_rate_by(c, "churned", ["tenant_id", "segment", "long_term"])


@register("churn_rate_overall", sql=f"""{_CUSTOMER_SQL}
SELECT count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned,
       CAST(sum(churned) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS churn_rate
FROM feat WHERE churned IS NOT NULL""")
def q_churn_rate_overall(spark, sf_dir):
    return churn.churn_rate_by(customer_table(spark, sf_dir), "churned", [])


@register("labelled_gate", sql=f"""{_CUSTOMER_SQL}
SELECT tenant_id, count(churned) AS labelled_rows, count(churned) >= 10 AS eligible,
       CASE WHEN count(churned) >= 10 THEN count(churned) ELSE 0 END AS training_rows
FROM feat GROUP BY tenant_id""")
def q_labelled_gate(spark, sf_dir):
    c = customer_table(spark, sf_dir)
    counts = churn.labelled_counts(c, "tenant_id", "churned")
    train = (churn.eligible_rows(c, "tenant_id", "churned").groupBy("tenant_id")
             .agg(F.count(F.lit(1)).alias("training_rows")))
    return (counts.join(train, on="tenant_id", how="left")
            .withColumn("training_rows", F.coalesce("training_rows", F.lit(0))))


def split_sql(classes: str, key: str = "c_custkey", rows: str = "feat") -> str:
    """CTEs ``cut``: the labelled rows with their part of an exact split, 20 %
    test and 10 % validation of each class."""
    return f"""
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY {classes} ORDER BY md5({key}::VARCHAR)) AS place,
           count(*) OVER (PARTITION BY {classes}) AS class_rows
    FROM {rows} WHERE churned IS NOT NULL),
  cut AS (
    SELECT *, CASE WHEN place <= floor((class_rows * 20 + 50) / 100) THEN 'test'
                   WHEN place <= floor((class_rows * 30 + 50) / 100) THEN 'validation'
                   ELSE 'train' END AS split
    FROM ranked)"""


@register("stratified_split_counts", sql=f"""{_CUSTOMER_SQL},{split_sql("tenant_id, churned")}
SELECT tenant_id, churned, split, count(*) AS rows,
       sum(c_custkey)::BIGINT AS keys FROM cut GROUP BY tenant_id, churned, split""")
def q_stratified_split_counts(spark, sf_dir):
    """Rows of each part of an exact split by tenant and label, with the sum
    of their keys."""
    c = customer_table(spark, sf_dir).where(F.col("churned").isNotNull())
    parts = split.stratified_split(c, "c_custkey", "churned", ["tenant_id"],
                                   churn.TEST_PERCENT, churn.VALIDATION_PERCENT)
    return parts.groupBy("tenant_id", "churned", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"))


# --- evaluation on a deterministic score over documents with quality labels ---

def scored_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.documents.join(t.labels, on="doc_id", how="inner")
            .select("doc_id", (F.col("n_chars").cast("double")
                               / (F.col("n_chars").cast("double") + F.lit(2000.0)))
                    .alias("score"), F.col("quality").alias("label")))


_SCORED_SQL = """
  scored AS (
    SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + CAST(2000 AS DOUBLE))
             AS score, l.quality AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_SWEEP_SQL = f"""
  {_SCORED_SQL},
  tot AS (SELECT count_if(label = 1) AS P, count_if(label <> 1) AS N FROM scored),
  th AS (SELECT CAST(j AS INTEGER) AS j, j / CAST(100 AS DOUBLE) AS threshold FROM range(10, 90) t(j)),
  cnt AS (
    SELECT th.j, th.threshold,
           count_if(s.score >= th.threshold AND s.label = 1) AS tp,
           count_if(s.score >= th.threshold AND s.label <> 1) AS fp
    FROM th LEFT JOIN scored s ON true GROUP BY th.j, th.threshold),
  sweep AS (
    SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
           CAST(P - tp AS BIGINT) AS fn, CAST(N - fp AS BIGINT) AS tn,
           CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END
             AS precision,
           CASE WHEN P = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) END AS recall,
           CASE WHEN 2 * tp + fp + (P - tp) = 0 THEN 0.0
                ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + (P - tp) AS DOUBLE) END AS f1
    FROM cnt CROSS JOIN tot)"""


@register("threshold_sweep", sql=f"WITH {_SWEEP_SQL}\nSELECT * FROM sweep")
def q_threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(scored_documents(spark, sf_dir), "score", "label")


@register("confusion_report", sql=f"""WITH {_SWEEP_SQL},
best AS (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1),
c AS (
  SELECT b.threshold,
         count_if(s.score >= b.threshold AND s.label = 1) AS tp,
         count_if(s.score >= b.threshold AND s.label <> 1) AS fp,
         count_if(s.score < b.threshold AND s.label = 1) AS fn,
         count_if(s.score < b.threshold AND s.label <> 1) AS tn
  FROM scored s CROSS JOIN best b GROUP BY b.threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tn AS BIGINT) AS tn,
       CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END
         AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END
         AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
            ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
FROM c""")
def q_confusion_report(spark, sf_dir):
    s = scored_documents(spark, sf_dir)
    best = evaluate.best_threshold(evaluate.threshold_sweep(s, "score", "label"))
    scored = attach_group_stats(s, best.select(F.col("threshold").alias("best_threshold")), [])
    return evaluate.confusion(scored, "score", "label", "best_threshold")


@register("roc_auc", sql=f"""WITH {_SCORED_SQL},
s AS (SELECT score, CAST(count_if(label = 1) AS DOUBLE) AS pos,
             CAST(count_if(label <> 1) AS DOUBLE) AS neg FROM scored GROUP BY score),
c AS (SELECT score, pos, neg,
             coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND 1 PRECEDING), 0) AS below FROM s)
SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c""")
def q_roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored_documents(spark, sf_dir), "score", "label")


@register("class_report", sql=f"""WITH {_SCORED_SQL},
c AS (SELECT count_if(score >= 0.5 AND label = 1)::DOUBLE AS tp,
             count_if(score >= 0.5 AND label <> 1)::DOUBLE AS fp,
             count_if(score < 0.5 AND label = 1)::DOUBLE AS fn,
             count_if(score < 0.5 AND label <> 1)::DOUBLE AS tn FROM scored WHERE label IS NOT NULL),
k AS (SELECT 0 AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f,
             tn + fp AS n FROM c
      UNION ALL SELECT 1, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c)
SELECT class::VARCHAR AS class, p AS precision, r AS recall, f AS f1, n::BIGINT AS support FROM k
UNION ALL SELECT 'macro avg', sum(p) / 2, sum(r) / 2, sum(f) / 2, sum(n)::BIGINT FROM k
UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n),
                 sum(n)::BIGINT FROM k""")
def q_class_report(spark, sf_dir):
    """Precision, recall, F1 and support of both classes and their means."""
    return evaluate.class_report(scored_documents(spark, sf_dir), "score", "label", 0.5)


@register("risk_tiers", sql=f"""WITH {_SCORED_SQL}
SELECT doc_id, score,
       CASE WHEN score >= 0.7 THEN 'High Risk' WHEN score >= 0.5 THEN 'Medium Risk'
            ELSE 'Low Risk' END AS prediction,
       least(greatest(abs(score - 0.5) * 2.0, 0.1), 0.9) AS confidence,
       CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS tier
FROM scored""")
def q_risk_tiers(spark, sf_dir):
    s = scored_documents(spark, sf_dir)
    return s.select("doc_id", "score", risk_label("score", 0.5).alias("prediction"),
                    confidence("score").alias("confidence"), display_tier("score").alias("tier"))


@register("class_weights", sql="""
WITH c AS (SELECT count_if(quality = 1) AS P, count_if(quality <> 1) AS N
           FROM labels WHERE quality IS NOT NULL)
SELECT 1 AS label, CAST(P AS BIGINT) AS rows,
       CASE WHEN P = 0 THEN 0.0 ELSE CAST(N AS DOUBLE) / CAST(P AS DOUBLE) END AS weight FROM c
UNION ALL
SELECT 0 AS label, CAST(N AS BIGINT) AS rows, 1.0 AS weight FROM c""")
def q_class_weights(spark, sf_dir):
    return evaluate.class_weights(Tables(spark, sf_dir).labels, "quality")


@register("new_customers_only", sql="""
WITH lim AS (SELECT min(o_orderdate) + INTERVAL 365 DAY AS lim FROM orders),
known AS (SELECT DISTINCT o.o_custkey FROM orders o CROSS JOIN lim WHERE o.o_orderdate < lim.lim)
SELECT c.c_nationkey AS tenant_id, c.c_custkey AS customer_id, c.c_mktsegment AS segment,
       0 AS total_orders, CAST(0 AS DOUBLE) AS total_spent, CAST(0 AS DOUBLE) AS avg_order_value
FROM customer c
WHERE c.c_custkey IS NOT NULL AND c.c_mktsegment IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.o_custkey = c.c_custkey)""")
def q_new_customers_only(spark, sf_dir):
    """Insert the customer table as a batch into a customer base made of the
    customers seen in the first year of orders: only unknown, complete,
    de-duplicated records are accepted, with 0 defaults for business fields."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_custkey", "o_orderdate")
    lim = o.agg((F.min("o_orderdate") + F.make_interval(days=F.lit(365))).alias("lim"))
    known_keys = (attach_group_stats(o, lim, []).where(F.col("o_orderdate") < F.col("lim"))
                  .select("o_custkey").distinct())
    incoming = t.customer.select(F.col("c_nationkey").alias("tenant_id"),
                                 F.col("c_custkey").alias("customer_id"),
                                 F.col("c_mktsegment").alias("segment"))
    existing = incoming.join(known_keys, F.col("customer_id") == F.col("o_custkey"), "left_semi")
    accepted, _rejected = sinks.new_rows_only(
        existing, incoming, ["tenant_id", "customer_id"], required=["customer_id", "segment"],
        defaults={"total_orders": 0, "total_spent": 0.0, "avg_order_value": 0.0})
    return accepted
