"""Churn classifier: train, evaluate, register, load and batch-score.

Gradient-boosted trees from Spark ML (distributed tree building) stand in
for the single-machine booster of the original.  Splits are hashes of the
customer key (train / validation / test), the validation part drives early
stopping and the F1-optimal threshold, and the untouched test part gives
the reported metrics.  Models live under a shared folder with an
append-only registry table; the active model of a tenant is its latest
version.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.scoring import confidence, risk_label
from mercato.operators import churn, encode, evaluate, split
from mercato.operators._util import attach_group_stats
from mercato.session import materialize

# Fixed values of the original booster, mapped onto Spark's GBT:
# 100 rounds, learning rate 0.05, 90 % of features and 80 % of rows per
# round, seed 42, early stop on the hold-out.  31 leaves ~ depth 5.
GBT_PARAMS = dict(maxIter=100, stepSize=0.05, maxDepth=5, featureSubsetStrategy="0.9",
                  subsamplingRate=0.8, seed=42, validationTol=0.001)
DEFAULT_THRESHOLD = 0.5

REGISTRY_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("training_rows", T.LongType()),
    T.StructField("labelled_rows", T.LongType()),
    T.StructField("tenant_rows", T.LongType()),
    T.StructField("level_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("medians", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("trained_at", T.TimestampType()),
])


@dataclass
class TrainedChurnModel:
    model: PipelineModel
    features: list[str]
    threshold: float
    metrics: dict
    feature_importance: dict[str, float]
    levels: DataFrame             # level table of the categorical columns
    sizes: dict[str, int]         # how many levels each of them has
    medians: dict[str, float]
    training_rows: int = 0
    labelled_rows: int = 0
    tenant_rows: int = 0          # all rows incl. unlabelled (the original's "training size")
    extra: dict = field(default_factory=dict)


CATEGORICAL = ("gender", "segment")


def prepare(df: DataFrame, as_of, levels: DataFrame | None = None,
            sizes: dict[str, int] | None = None, medians: dict[str, float] | None = None,
            keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Feature engineering shared by training and scoring: ``keep``, the
    numeric features, the categorical columns and their sparse vectors, with
    the level table that was learnt or given."""
    med_df = None
    if medians is not None:
        med_df = df.sparkSession.createDataFrame(
            [tuple(float(v) for v in medians.values())],
            T.StructType([T.StructField(f"median__{k}", T.DoubleType()) for k in medians]))
    f = churn.churn_features(df, as_of, medians=med_df)
    f = f.withColumns({c: F.lit(churn.UNKNOWN) for c in CATEGORICAL if c not in f.columns})
    if levels is None:
        levels = materialize(encode.level_table(f, CATEGORICAL))
        sizes = encode.level_counts(levels)
    f = churn.align_features(f, churn.NUMERIC_FEATURES, keep=[*keep, *CATEGORICAL])
    return encode.encode(f, levels, sizes), levels, sizes


def train_churn_model(customers: DataFrame, as_of, *, key_col: str = "customer_id",
                      label_col: str = "churned", seed: int = 42,
                      gbt_params: dict | None = None) -> TrainedChurnModel:
    """Fit on the labelled rows of ``customers`` (one tenant's, or a pooled
    table).  Returns the fitted pipeline with threshold and metrics."""
    lab = customers.where(F.col(label_col).isNotNull())
    medians_row = churn.median_table(lab, ["age"]).first() if "age" in lab.columns else None
    medians = {"age": medians_row["median__age"]} if medians_row and \
        medians_row["median__age"] is not None else {}
    feats, levels, sizes = prepare(lab, as_of, None, None, medians or None, [key_col, label_col])
    inputs = [*churn.NUMERIC_FEATURES, *[f"{c}_vec" for c in sizes]]
    # read by every step of the fit and by the evaluation
    data = materialize(split.stratified_split(
        feats.withColumn("label", F.col(label_col).cast("double")),
        key_col, "label", (), churn.TEST_PERCENT, churn.VALIDATION_PERCENT))
    fit_rows = data.where(F.col("split") != "test")
    fit_rows = evaluate.with_class_weight(fit_rows, "label", "weight")
    fit_rows = fit_rows.withColumn("is_validation", F.col("split") == "validation")
    params = dict(GBT_PARAMS, seed=seed, **(gbt_params or {}))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                        validationIndicatorCol="is_validation", **params)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features",
                                            handleInvalid="keep"), gbt])
    model = pipe.fit(fit_rows)
    scored = (model.transform(data)
              .withColumn("score", vector_to_array("probability").getItem(1)))
    val = scored.where(F.col("split") == "validation")
    test = scored.where(F.col("split") == "test")
    best = evaluate.best_threshold(evaluate.threshold_sweep(val, "score", "label")).first()
    thr = float(best["threshold"]) if best is not None else DEFAULT_THRESHOLD
    rep = evaluate.confusion(test, "score", "label", thr).first()
    auc = evaluate.roc_auc(test, "score", "label").first()
    counts = data.groupBy().agg(F.count_if(F.col("split") != "test").alias("fit"),
                                F.count(F.lit(1)).alias("all")).first()
    tenant_rows = customers.count()
    imp = named_importance(model.stages[-1].featureImportances, levels, sizes)
    metrics = {
        "threshold": thr,
        "accuracy": rep["accuracy"] if rep else None,
        "precision": rep["precision"] if rep else None,
        "recall": rep["recall"] if rep else None,
        "f1_score": rep["f1"] if rep else None,
        "auc": auc["auc"] if auc else None,
        "confusion_matrix": [[rep["tn"], rep["fp"]], [rep["fn"], rep["tp"]]] if rep else None,
        "trees": model.stages[-1].getNumTrees,
    }
    return TrainedChurnModel(model, [*churn.NUMERIC_FEATURES, *sizes], thr, metrics, imp, levels,
                             sizes, medians, training_rows=int(counts["fit"]), labelled_rows=int(counts["all"]),
                             tenant_rows=int(tenant_rows))


def named_importance(importance, levels: DataFrame, sizes: dict[str, int]) -> dict[str, float]:
    """Feature -> importance: every numeric feature, and the levels that the
    trees split on (no more of them than the trees have nodes)."""
    numeric = list(churn.NUMERIC_FEATURES)
    out = {f: float(importance[i]) for i, f in enumerate(numeric)}
    first = len(numeric)
    for c, n in sizes.items():
        used = {int(i) - first: float(v) for i, v in zip(importance.indices, importance.values)
                if first <= i < first + n}
        named = levels.where((F.col("column") == c) & F.col("index").isin(list(used)))
        out |= {f"{c}_{r['value']}": used[r["index"]] for r in named.collect()}
        first += n
    return out


def score_churn(trained: TrainedChurnModel, customers: DataFrame, as_of,
                key_col: str = "customer_id", keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring: probability, confidence, risk label, threshold and the
    model inputs as a struct.  Unseen categories encode as all zeros and
    missing features as 0; ages are filled with the training median."""
    x, _, _ = prepare(customers, as_of, trained.levels, trained.sizes, trained.medians or None,
                      [key_col, *keep])
    scored = trained.model.transform(x).withColumn(
        "churn_probability", vector_to_array("probability").getItem(1))
    thr = F.lit(float(trained.threshold))
    return scored.select(
        key_col, *keep, "churn_probability",
        confidence("churn_probability").alias("confidence"),
        risk_label("churn_probability", thr).alias("prediction"),
        thr.alias("threshold"),
        F.struct(*trained.features).alias("input_features"))


# --- registry -------------------------------------------------------------

def register_model(spark: SparkSession, trained: TrainedChurnModel, store_dir: str,
                   tenant_id: int, name: str = "churn_model") -> dict:
    """Save the pipeline under a path of its own and append a registry row.

    Versions are not handed out but read from the log (:func:`registry`), so
    trainings that run at once can neither take the same version nor
    overwrite each other's model.  The active model is the latest version."""
    reg_path = os.path.join(store_dir, "registry")
    path = os.path.join(store_dir, f"tenant={tenant_id}", name, uuid.uuid4().hex)
    trained.model.write().save(path)
    trained.levels.write.parquet(f"{path}/levels")
    m = trained.metrics
    row = (int(tenant_id), name, None, "spark-gbt", path, list(trained.features),
           {k: float(v) for k, v in trained.feature_importance.items()}, float(trained.threshold),
           m.get("accuracy"), m.get("precision"), m.get("recall"), m.get("f1_score"), m.get("auc"),
           int(trained.training_rows), int(trained.labelled_rows), int(trained.tenant_rows),
           {k: int(v) for k, v in trained.sizes.items()},
           {k: float(v) for k, v in trained.medians.items()},
           _dt.datetime.now(_dt.timezone.utc))
    spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(reg_path)
    own = registry(spark, store_dir).where(F.col("model_path") == path).first()
    return {"tenant_id": tenant_id, "version": own["version"], "model_path": path}


def registry(spark: SparkSession, store_dir: str) -> DataFrame:
    """The log with each row's ``version``: its place among the rows of its
    tenant and name, by time and then by path."""
    log = spark.read.schema(REGISTRY_SCHEMA).parquet(os.path.join(store_dir, "registry"))
    w = Window.partitionBy("tenant_id", "name").orderBy("trained_at", "model_path")
    return log.withColumn("version", F.row_number().over(w).cast("long"))


def active_models(reg: DataFrame) -> DataFrame:
    """Latest version per (tenant, name)."""
    rest = [c for c in reg.columns if c not in ("tenant_id", "name")]
    return (reg.groupBy("tenant_id", "name")
            .agg(F.max_by(F.struct(*rest), "version").alias("r"))
            .select("tenant_id", "name", *[F.col(f"r.{c}").alias(c) for c in rest]))


def load_active(spark: SparkSession, store_dir: str, tenant_id: int,
                name: str = "churn_model") -> TrainedChurnModel | None:
    row = (active_models(registry(spark, store_dir))
           .where((F.col("tenant_id") == tenant_id) & (F.col("name") == name)).first())
    if row is None:
        return None
    model = PipelineModel.load(row["model_path"])
    return TrainedChurnModel(model, list(row["features"]), float(row["threshold"]),
                             {"accuracy": row["accuracy"], "auc": row["auc"]},
                             dict(row["feature_importance"]),
                             spark.read.parquet(f"{row['model_path']}/levels"),
                             dict(row["level_counts"]), dict(row["medians"]), row["training_rows"], row["labelled_rows"],
                             row["tenant_rows"] or 0)


def with_tenant(df: DataFrame, tenant_id: int) -> DataFrame:
    return attach_group_stats(df, df.sparkSession.createDataFrame(
        [(int(tenant_id),)], "tenant_id long"), [])


def train_for_tenant(spark: SparkSession, customers: DataFrame, tenant_id: int, as_of,
                     store_dir: str, tenant_col: str = "tenant_id", label_col: str = "churned",
                     **kw) -> dict:
    """Train-and-register entry point for one tenant: the labelled-row gate
    (at least 10 labels), the fit on that tenant's rows (the scan prunes the
    other tenants' partitions), and the registry append."""
    rows = customers.where(F.col(tenant_col) == tenant_id)
    n = rows.where(F.col(label_col).isNotNull()).count()
    if n < churn.MIN_LABELLED_ROWS:
        return {"success": False, "tenant_id": tenant_id, "labelled_rows": n,
                "message": f"at least {churn.MIN_LABELLED_ROWS} labelled rows are needed"}
    trained = train_churn_model(rows, as_of, label_col=label_col, **kw)
    info = register_model(spark, trained, store_dir, tenant_id)
    return {"success": True, **info, "metrics": trained.metrics}
