"""Demand features, a demand regressor, and batch demand scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import lenient_number_or_zero, lenient_timestamp, weekday_mon0
from mercato.operators import encode
from mercato.session import materialize

# The scoring features, in model order.
DEMAND_FEATURES = ("quantity", "price", "month", "day_of_week", "day_of_year")


def demand_features(df: DataFrame, date_col: str = "order_date", qty_col: str = "quantity",
                    price_col: str = "price", keep: Sequence[str] = ()) -> DataFrame:
    """quantity, price, month, day of week (Mon = 0), day of year; missing or
    unparsable inputs -> 0."""
    t = dict(df.dtypes).get(date_col)
    d = lenient_timestamp(date_col) if t == "string" else F.col(date_col)
    cols = [F.col(c) for c in keep]
    num = lambda c: lenient_number_or_zero(c) if c in df.columns else F.lit(0.0)
    if t is None:
        parts = [F.lit(0).alias(n) for n in ("month", "day_of_week", "day_of_year")]
    else:
        parts = [F.coalesce(F.month(d), F.lit(0)).alias("month"),
                 F.coalesce(weekday_mon0(d), F.lit(0)).alias("day_of_week"),
                 F.coalesce(F.dayofyear(d), F.lit(0)).alias("day_of_year")]
    return df.select(*cols, num(qty_col).alias("quantity"), num(price_col).alias("price"), *parts)


@dataclass
class DemandModel:
    """A regressor and, where it knows items, the table of their means."""

    model: PipelineModel
    item_col: str | None = None
    means: DataFrame | None = None
    overall: DataFrame | None = None


def demand_pipeline(features: Sequence[str] = ("price", "month", "day_of_week", "day_of_year"),
                    label_col: str = "quantity") -> Pipeline:
    """Regressor of quantity on the calendar/price features (quantity itself is
    the target and is not a feature)."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
              LinearRegression(featuresCol="features", labelCol=label_col,
                               predictionCol="predicted_quantity", regParam=0.0,
                               elasticNetParam=0.0, maxIter=50)]
    return Pipeline(stages=stages)


def train_demand(df: DataFrame, item_col: str | None = None, key: str | Column | None = None
                 ) -> DemandModel:
    """Fit on the rows of ``df``.  With ``item_col`` each row also has the
    mean quantity of its item over the other folds (by a hash of ``key``, all
    columns by default): one feature however many items there are, and no
    state an item in the model or on the driver."""
    features = ("price", "month", "day_of_week", "day_of_year")
    if item_col is None:
        return DemandModel(demand_pipeline(features).fit(df))
    if key is None:
        key = F.to_json(F.struct(*df.columns))
    rows = encode.with_out_of_fold_means(df, item_col, "quantity", key)
    model = demand_pipeline((*features, "item_mean")).fit(rows)
    return DemandModel(model, item_col, materialize(encode.item_means(df, item_col, "quantity")),
                       materialize(encode.overall_mean(df, "quantity")))


def score_demand(trained: DemandModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    if trained.item_col is not None:
        df = encode.with_item_means(df, trained.means, trained.overall, trained.item_col)
    return trained.model.transform(df).select(
        *keep, *[c for c in DEMAND_FEATURES if c in df.columns], "predicted_quantity")
