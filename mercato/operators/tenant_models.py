"""A churn model for every eligible tenant, all trained in the same jobs.

Each tenant has a logistic model of its own.  A Newton step needs, for each
tenant, the sums of the gradient and of the second derivatives over its
rows: one aggregate for all tenants, with partial sums, so a tenant that
holds a third of the rows is no one task's.  The small linear systems (one
row a tenant) are solved by elimination in column expressions.  There is no
loop over tenants and nothing that grows with them reaches the driver.

Features are standardised by the tenant's own mean and spread (a constant
feature counts nothing), classes are balanced by weight, and ``RIDGE`` keeps
separable tenants finite.  ``last_step`` is the largest change of a weight
in the last step, for those that want to see that it is small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.functions.scoring import confidence, risk_label
from mercato.operators import churn, evaluate
from mercato.operators._util import keys, null_safe_join, salted_join
from mercato.operators.split import stratified_split
from mercato.session import materialize

RIDGE = 1.0
STEPS = 10
DEFAULT_THRESHOLD = 0.5
FEATURES = ("age", "subscription_length", "days_since_last_login", "total_orders", "total_spent",
            "avg_order_value")
TRAINED, TOO_FEW, ONE_CLASS = "trained", "too few labelled rows", "labels of one class only"


def training_gate(df: DataFrame, tenant_col: str = "tenant_id", label_col: str = "churned",
                  min_rows: int = churn.MIN_LABELLED_ROWS) -> DataFrame:
    """(tenant, tenant_rows, labelled_rows, positives, status) of every tenant."""
    counts = df.groupBy(tenant_col).agg(
        F.count(F.lit(1)).alias("tenant_rows"), F.count(label_col).alias("labelled_rows"),
        F.count_if(F.col(label_col) == 1).alias("positives"))
    return counts.withColumn(
        "status", F.when(F.col("labelled_rows") < min_rows, TOO_FEW)
        .when(F.col("positives").isin(0) | (F.col("positives") == F.col("labelled_rows")), ONE_CLASS)
        .otherwise(TRAINED))


def _inputs(features: Sequence[str]) -> Column:
    """The model's inputs: 1 and the standardised features."""
    terms = [F.lit(1.0)]
    for i, f in enumerate(features):
        spread = F.col("spreads")[i]
        terms.append(F.when(spread > 0, (F.coalesce(F.col(f).cast("double"), F.lit(0.0))
                                         - F.col("means")[i]) / spread).otherwise(0.0))
    return F.array(*terms)


def _probability(n: int, inputs: str = "inputs") -> Column:
    z = F.lit(0.0)
    for i in range(n):
        z = z + F.col(inputs)[i] * F.col("weights")[i]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _solved(matrix: Column, n: int) -> Column:
    """Solution of ``n`` equations, given as rows of coefficients and right
    side, symmetric and positive definite: Gauss-Jordan elimination."""
    def eliminated(m, k):
        pivot = F.transform(F.get(m, k), lambda x: x / F.get(F.get(m, k), k))
        return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(
            F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, eliminated)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))


def fit_tenants(rows: DataFrame, tenant_col: str = "tenant_id", label_col: str = "churned",
                features: Sequence[str] = FEATURES, steps: int = STEPS) -> DataFrame:
    """(tenant, means, spreads, weights, training_rows, last_step) from
    labelled rows; every tenant needs rows of both classes."""
    t, n = keys(tenant_col), len(features) + 1
    value = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    stats = rows.groupBy(*t).agg(
        F.array(*[F.avg(v) for v in value]).alias("means"),
        F.array(*[F.stddev_pop(v) for v in value]).alias("spreads"),
        F.count(F.lit(1)).alias("training_rows"),
        (F.count_if(F.col(label_col) != 1) / F.count_if(F.col(label_col) == 1)).alias("balance"))
    stats = materialize(stats)
    x = salted_join(rows.select(*t, label_col, *features), stats, t)
    y = F.col(label_col).cast("double")
    x = materialize(x.select(*t, y.alias("y"), F.when(y == 1, F.col("balance")).otherwise(1.0)
                             .alias("w"), _inputs(features).alias("inputs")))
    models = stats.select(*t, F.array(*[F.lit(0.0)] * n).alias("weights"),
                          F.lit(0.0).alias("last_step"))
    for _ in range(steps):
        p = salted_join(x, models, t).withColumn("p", _probability(n))
        inputs = [F.col("inputs")[i] for i in range(n)]
        slope, bend = F.col("w") * (F.col("y") - F.col("p")), F.col("w") * F.col("p") * (1 - F.col("p"))
        sums = p.groupBy(*t).agg(
            F.array(*[F.sum(slope * a) for a in inputs]).alias("slopes"),
            F.array(*[F.sum(bend * inputs[i] * inputs[j]) for i in range(n) for j in range(i, n)])
            .alias("bends"))
        at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n))}
        both = null_safe_join(models, sums, t)
        equations = F.array(*[F.array(
            *[F.col("bends")[at[min(i, j), max(i, j)]]
              + ((RIDGE if i else 1e-9) if i == j else 0.0) for j in range(n)],
            F.col("slopes")[i] - (RIDGE * F.col("weights")[i] if i else 0.0)) for i in range(n)])
        both = both.withColumn("change", _solved(equations, n))
        models = materialize(both.select(
            *t, F.zip_with("weights", "change", lambda a, b: a + b).alias("weights"),
            F.array_max(F.transform("change", F.abs)).alias("last_step")))
    return null_safe_join(stats.drop("balance"), models, t)


@dataclass
class TenantTraining:
    gate: DataFrame           # every tenant with its label counts and status
    models: DataFrame         # every trained tenant with weights, threshold and test metrics
    parts: DataFrame          # the labelled rows of trained tenants with their part


def train_tenants(customers: DataFrame, tenant_col: str = "tenant_id",
                  key_col: str = "customer_id", label_col: str = "churned",
                  features: Sequence[str] = FEATURES,
                  min_rows: int = churn.MIN_LABELLED_ROWS) -> TenantTraining:
    """Gate, exact stratified split, fit on the train part, F1-best threshold
    on the validation part, metrics on the test part: for every tenant."""
    t = keys(tenant_col)
    gate = materialize(training_gate(customers, tenant_col, label_col, min_rows))
    ready = gate.where(F.col("status") == TRAINED).select(*t)
    labelled = null_safe_join(customers.where(F.col(label_col).isNotNull()), ready, t, "left_semi")
    parts = materialize(stratified_split(labelled.select(*t, key_col, label_col, *features), key_col,
                                         label_col, t, churn.TEST_PERCENT, churn.VALIDATION_PERCENT))
    fitted = fit_tenants(parts.where("split = 'train'"), tenant_col, label_col, features)
    scored = salted_join(parts.where("split <> 'train'"), fitted, t)
    scored = materialize(scored.withColumn("inputs", _inputs(features)).select(
        *t, "split", F.col(label_col).cast("int").alias("label"),
        _probability(len(features) + 1).alias("score")))
    sweep = evaluate.threshold_sweep(scored.where("split = 'validation'"), "score", "label", t)
    best = evaluate.best_threshold(sweep, t).select(*t, "threshold")
    models = null_safe_join(fitted, best, t, "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    test = salted_join(scored.where("split = 'test'"), models.select(*t, "threshold"), t)
    report = evaluate.confusion(test, "score", "label", "threshold", t).drop("threshold")
    auc = evaluate.roc_auc(test, "score", "label", t).select(*t, "auc")
    models = null_safe_join(null_safe_join(models, report, t, "left"), auc, t, "left")
    return TenantTraining(gate, models, parts)


def score_tenants(models: DataFrame, customers: DataFrame, tenant_col: str = "tenant_id",
                  features: Sequence[str] = FEATURES, keep: Sequence[str] = ("customer_id",)
                  ) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): customers of tenants with a model, with
    probability, confidence, label and the inputs; and the others with the
    reason why they are not scored.  Together they hold every row."""
    t = keys(tenant_col)
    known = models.select(*t, "means", "spreads", "weights", "threshold",
                          F.lit(True).alias("has_model"))
    joined = salted_join(customers.select(*t, *keep, *features), known, t, how="left")
    scored = joined.where("has_model").withColumn("inputs", _inputs(features)).select(
        *t, *keep, _probability(len(features) + 1).alias("churn_probability"), "threshold",
        F.struct(*features).alias("input_features"))
    scored = scored.withColumns({"confidence": confidence("churn_probability"),
                                 "prediction": risk_label("churn_probability", F.col("threshold"))})
    rejected = joined.where("has_model IS NULL").select(
        *t, *keep, F.lit("the tenant has no active model").alias("reason"))
    return scored, rejected


# --- a store that several trainings may write at once ----------------------

def save_models(training: TenantTraining, store_dir: str) -> str:
    """Append one run under a path of its own; no run sees or waits for another."""
    run = uuid.uuid4().hex
    (training.models.withColumn("trained_at", F.current_timestamp())
     .write.mode("errorifexists").parquet(f"{store_dir.rstrip('/')}/run={run}"))
    return run


def model_log(spark: SparkSession, store_dir: str, tenant_col: str = "tenant_id") -> DataFrame:
    """Every saved model with its ``version`` within the tenant, resolved
    from the log: 1 is the first by time (ties: by run), and ``is_active``,
    the last."""
    runs = spark.read.option("basePath", store_dir).parquet(f"{store_dir.rstrip('/')}/run=*")
    order = [F.col("trained_at"), F.col("run")]
    w = Window.partitionBy(tenant_col)          # a row for each training of the tenant
    return runs.withColumns({
        "version": F.row_number().over(w.orderBy(*order)).cast("long"),
        "is_active": F.row_number().over(w.orderBy(*[c.desc() for c in order])) == 1})
