"""Training and scoring of every tenant (here: a nation's customers of one
market segment, so that some tenants have too few labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mercato.catalog import register
from mercato.catalog.q_churn import _CUSTOMER_SQL, customer_features, split_sql
from mercato.operators import tenant_models
from mercato.session import scratch_path


def _customers(spark, sf_dir):
    c = customer_features(spark, sf_dir).withColumnRenamed("c_custkey", "customer_id")
    return c.withColumn("tenant_id", F.concat_ws("/", F.col("tenant_id").cast("string"), "segment"))


@register("tenant_training", sql=f"""{_CUSTOMER_SQL},
own AS (SELECT * REPLACE (tenant_id::VARCHAR || '/' || segment AS tenant_id) FROM feat),
gate AS (
  SELECT tenant_id, count(*) AS tenant_rows, count(churned) AS labelled_rows,
         count(*) FILTER (churned = 1) AS positives,
         CASE WHEN count(churned) < 10 THEN 'too few labelled rows'
              WHEN count(*) FILTER (churned = 1) IN (0, count(churned))
              THEN 'labels of one class only' ELSE 'trained' END AS status
  FROM own GROUP BY tenant_id),
{split_sql("tenant_id, churned", rows="own")},
parts AS (
  SELECT tenant_id, count(*) FILTER (split = 'train') AS train_rows,
         count(*) FILTER (split = 'validation') AS validation_rows,
         count(*) FILTER (split = 'test') AS test_rows
  FROM cut GROUP BY tenant_id)
SELECT g.tenant_id, tenant_rows, labelled_rows, positives, status,
       CASE WHEN status = 'trained' THEN train_rows ELSE 0 END AS train_rows,
       CASE WHEN status = 'trained' THEN validation_rows ELSE 0 END AS validation_rows,
       CASE WHEN status = 'trained' THEN test_rows ELSE 0 END AS test_rows,
       CASE WHEN status = 'trained' THEN tenant_rows ELSE 0 END AS scored_rows,
       CASE WHEN status = 'trained' THEN 0 ELSE tenant_rows END AS rejected_rows,
       CASE WHEN status = 'trained' THEN 2 ELSE 0 END AS versions
FROM gate g LEFT JOIN parts p ON g.tenant_id = p.tenant_id""")
def q_tenant_training(spark, sf_dir):
    """Trained and refused tenants with their label counts, the rows of each
    part, and the customers scored with the tenant's active model; trained
    and saved twice, which makes two versions."""
    customers = _customers(spark, sf_dir)
    done = tenant_models.train_tenants(customers)
    store = scratch_path(spark, "tenant-models")
    for _ in range(2):
        tenant_models.save_models(done, store)
    log = tenant_models.model_log(spark, store)
    scored, rejected = tenant_models.score_tenants(log.where("is_active"), customers)
    pieces = [done.parts.groupBy("tenant_id").agg(*[
        F.count_if(F.col("split") == p).alias(f"{p}_rows") for p in ("train", "validation", "test")]),
        scored.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("scored_rows")),
        rejected.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rejected_rows")),
        log.groupBy("tenant_id").agg(F.max("version").cast("int").alias("versions"))]
    out = done.gate
    for piece in pieces:
        out = out.join(piece, "tenant_id", "left")
    return out.fillna(0)
