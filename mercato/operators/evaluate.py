"""Binary-classifier evaluation as aggregates: threshold sweep (best F1),
confusion counts, accuracy/precision/recall/F1, tie-aware ROC-AUC and class
weights.  Scores are reduced to per-bucket / per-distinct-score counts
first, so no step ever sorts the scored rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.scoring import (RISK_THRESHOLD_HIGH, RISK_THRESHOLD_LOW,
                                       threshold_bucket)
from mercato.operators._util import attach_group_stats, keys, null_safe_join, with_bucket

AUC_BUCKETS = 64


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def bucket_counts(df: DataFrame, score_col: str, label_col: str,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per threshold bucket (at most 81 rows a group)."""
    g = keys(group_cols)
    lab = F.col(label_col).cast("int")
    return (df.where(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
            .groupBy(*g, threshold_bucket(score_col).alias("bucket"))
            .agg(F.count_if(lab == 1).alias("pos"), F.count_if(lab != 1).alias("neg")))


def threshold_sweep(df: DataFrame, score_col: str = "score", label_col: str = "label",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn/tn, precision, recall and F1 for thresholds 0.10 ... 0.89
    (predict positive when score >= threshold; 0 when undefined)."""
    g = keys(group_cols)
    b = bucket_counts(df, score_col, label_col, g)
    grid = (b.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
            .select(*g, "P", "N", F.explode(F.sequence(F.lit(RISK_THRESHOLD_LOW - 1),
                                                      F.lit(RISK_THRESHOLD_HIGH))).alias("bucket")))
    full = null_safe_join(grid, b, [*g, "bucket"], "left", equal=["bucket"]).fillna(0, subset=["pos", "neg"])
    # <= 81 rows per group: the running sum over buckets is a tiny window
    w = (Window.partitionBy(*g).orderBy(F.col("bucket").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = (full.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
           .where(F.col("bucket") >= RISK_THRESHOLD_LOW))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return cum.select(
        *g, (F.col("bucket") / F.lit(100.0)).alias("threshold"),
        tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"), tn.cast("long").alias("tn"),
        _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(sweep: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Row of the sweep with the largest F1 (smallest threshold on ties)."""
    g = keys(group_cols)
    rest = [c for c in sweep.columns if c not in g]
    pick = F.max_by(F.struct(*rest), F.struct(F.col("f1"), (-F.col("threshold")).alias("t")))
    return sweep.groupBy(*g).agg(pick.alias("b")).select(*g, *[F.col(f"b.{c}").alias(c)
                                                              for c in rest])


def confusion(df: DataFrame, score_col: str, label_col: str, threshold,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and accuracy / precision / recall / F1 at a threshold
    (a number, or a column of ``df`` holding one value per group)."""
    g = keys(group_cols)
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else F.col(threshold)
    lab = F.col(label_col).cast("int") == 1
    pred = F.col(score_col) >= thr
    c = (df.where(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
         .groupBy(*g).agg(F.max(thr).alias("threshold"),
                          F.count_if(pred & lab).alias("tp"), F.count_if(pred & ~lab).alias("fp"),
                          F.count_if(~pred & lab).alias("fn"), F.count_if(~pred & ~lab).alias("tn")))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*g, "threshold", "tp", "fp", "fn", "tn",
                    _safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _safe_div(tp, tp + fp).alias("precision"),
                    _safe_div(tp, tp + fn).alias("recall"),
                    _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def class_report(df: DataFrame, score_col: str, label_col: str, threshold,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class ("0" and "1") and of
    their plain ("macro avg") and weighted ("weighted avg") means."""
    g = keys(group_cols)
    c = confusion(df, score_col, label_col, threshold, g)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), _safe_div(hit, hit + wrong).alias("precision"),
                        _safe_div(hit, hit + missed).alias("recall"),
                        _safe_div(2 * hit, 2 * hit + wrong + missed).alias("f1"),
                        (hit + missed).cast("long").alias("support"))

    both = c.select(*g, line("0", tn, fn, fp).alias("n"), line("1", tp, fp, fn).alias("p"))
    total = F.col("n.support") + F.col("p.support")

    def mean(name: str, n: Column, p: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[
            ((F.col(f"n.{m}") * n + F.col(f"p.{m}") * p) / (n + p)).alias(m)
            for m in ("precision", "recall", "f1")], total.alias("support"))

    return both.select(*g, F.inline(F.array(
        F.col("n"), F.col("p"), mean("macro avg", F.lit(1), F.lit(1)),
        mean("weighted avg", F.col("n.support"), F.col("p.support")))))


def roc_auc(df: DataFrame, score_col: str = "score", label_col: str = "label",
            group_cols: Sequence[str] = (), buckets: int = AUC_BUCKETS) -> DataFrame:
    """Exact, tie-aware ROC-AUC (Mann-Whitney): P(score+ > score-) + 0.5 P(=).

    Rows collapse to per-distinct-score counts; the negatives below each score
    come from a window per (group, score bucket) plus per-bucket offsets,
    with buckets cut at approximate quantiles of the distinct scores so the
    windows stay balanced.  All sums are of integers and halves: exact."""
    g = keys(group_cols)
    lab = F.col(label_col).cast("int")
    s = (df.where(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
         .groupBy(*g, F.col(score_col).cast("double").alias("score"))
         .agg(F.count_if(lab == 1).alias("pos"), F.count_if(lab != 1).alias("neg")))
    cuts = s.groupBy(*g).agg(F.percentile_approx(
        "score", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts"))
    sb = with_bucket(attach_group_stats(s, cuts, g), "cuts", F.col("score"), buckets - 1,
                     "b").drop("cuts")
    local = sb.withColumn("neg_local", F.coalesce(F.sum("neg").over(
        Window.partitionBy(*g, "b").orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    off = (sb.groupBy(*g, "b").agg(F.sum("neg").alias("bn"))
           .withColumn("neg_off", F.coalesce(F.sum("bn").over(
               Window.partitionBy(*g).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)),
               F.lit(0))).drop("bn"))
    ranked = null_safe_join(local, off, [*g, "b"], equal=["b"])
    below = (F.col("neg_local") + F.col("neg_off")).cast("double")
    return ranked.groupBy(*g).agg(
        F.sum(F.col("pos").cast("double") * (below + F.lit(0.5) * F.col("neg").cast("double")))
        .alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).select(
        *g, F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
        .otherwise(F.col("u") / (F.col("P").cast("double") * F.col("N").cast("double")))
        .alias("auc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def class_weights(df: DataFrame, label_col: str = "label", group_cols: Sequence[str] = ()
                  ) -> DataFrame:
    """Per class: rows and weight (positives weigh n_neg / n_pos, negatives 1),
    the usual balancing for an imbalanced binary label."""
    g = keys(group_cols)
    lab = F.col(label_col).cast("int")
    c = (df.where(F.col(label_col).isNotNull()).groupBy(*g)
         .agg(F.count_if(lab == 1).alias("P"), F.count_if(lab != 1).alias("N")))
    rows = c.select(*g, F.inline(F.array(
        F.struct(F.lit(1).alias("label"), F.col("P").alias("rows"),
                 _safe_div(F.col("N"), F.col("P")).alias("weight")),
        F.struct(F.lit(0).alias("label"), F.col("N").alias("rows"),
                 F.lit(1.0).alias("weight")))))
    return rows


def with_class_weight(df: DataFrame, label_col: str = "label", out: str = "weight",
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Row weight column for ``weightCol`` of Spark ML estimators."""
    g = keys(group_cols)
    w = class_weights(df, label_col, g).where(F.col("label") == 1).select(*g, F.col("weight")
                                                                          .alias("__wpos"))
    return (attach_group_stats(df, w, g)
            .withColumn(out, F.when(F.col(label_col).cast("int") == 1, F.col("__wpos"))
                        .otherwise(F.lit(1.0))).drop("__wpos"))
