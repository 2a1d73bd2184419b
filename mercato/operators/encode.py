"""Encodings of categories and items that may have any number of levels.

Levels live in a table, never on the driver: a join gives each row the index
of its level, and a one-hot encoder that knows only the number of levels
makes a sparse vector of it.  Items can also be encoded by their mean,
learnt out of fold.  Joins are salted, so that a level which holds a third of
the rows is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators._util import attach_group_stats, keys, null_safe_join, range_index, salted_join
from mercato.operators.split import hash_part
from mercato.session import materialize

FOLDS = 5


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, rows, index): the levels of each column as text, with
    their number of rows and their place in the order of the values."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("c")).select("c.*").where("value IS NOT NULL")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    return range_index(counts, ["value"], ["column"], out="index")


def level_counts(levels: DataFrame) -> dict[str, int]:
    """How many levels each column has: a number a column."""
    return {r["column"]: r["n"] for r in
            levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def encode(df: DataFrame, levels: DataFrame, sizes: dict[str, int], drop_source: bool = False
           ) -> DataFrame:
    """``df`` with ``<column>_index`` and the sparse vector ``<column>_vec``
    for each column of ``sizes`` (from :func:`level_counts`).  A value
    without a level, or null, has the index after the last and all zeros."""
    out = df
    for c, n in sizes.items():
        own = levels.where(F.col("column") == c).select(F.col("value").alias("__value"),
                                                        F.col("index").alias("__index"))
        out = salted_join(out.withColumn("__value", F.col(c).cast("string")), own, ["__value"],
                          how="left")
        # the encoder takes the number of levels from here and looks at no row
        known = {"ml_attr": {"type": "nominal", "name": f"{c}_index", "num_vals": n + 1}}
        out = out.withColumn(f"{c}_index", F.coalesce("__index", F.lit(n)).cast("double")
                             .alias(f"{c}_index", metadata=known)).drop("__value", "__index")
        out = OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_vec").fit(out).transform(out)
        if drop_source:
            out = out.drop(c)
    return out


def fold_of(key: str | Column, folds: int = FOLDS) -> Column:
    """The fold of a row, from a hash of its key that SQL can compute."""
    return hash_part(key, folds)


def item_means(df: DataFrame, item_col: str, value_col: str) -> DataFrame:
    """(item, item_mean, item_rows): what new rows are encoded with."""
    return df.groupBy(item_col).agg(F.avg(F.col(value_col).cast("double")).alias("item_mean"),
                                    F.count(F.lit(1)).alias("item_rows"))


def overall_mean(df: DataFrame, value_col: str) -> DataFrame:
    return df.agg(F.avg(F.col(value_col).cast("double")).alias("__overall"))


def with_out_of_fold_means(df: DataFrame, item_col: str, value_col: str, key: str | Column,
                           folds: int = FOLDS) -> DataFrame:
    """``df`` with ``fold`` and ``item_mean``: the mean of ``value_col`` over
    the item's rows of all other folds, so that no row's own value is in its
    encoding; the overall mean where the other folds lack the item."""
    i = keys(item_col)
    value = F.col(value_col).cast("double")
    rows = df.withColumn("fold", fold_of(key, folds))
    parts = materialize(rows.groupBy(*i, "fold").agg(F.sum(value).alias("s"),
                                                     F.count(value).alias("n")))
    totals = parts.groupBy(*i).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    others = null_safe_join(parts, totals, i).select(
        *i, "fold", F.try_divide(F.col("all_s") - F.coalesce("s", F.lit(0.0)),
                                 F.col("all_n") - F.col("n")).alias("item_mean"))
    out = attach_group_stats(salted_join(rows, others, [*i, "fold"]),
                             overall_mean(df, value_col), [])
    return out.withColumn("item_mean", F.coalesce("item_mean", "__overall")).drop("__overall")


def with_item_means(df: DataFrame, means: DataFrame, overall: DataFrame, item_col: str) -> DataFrame:
    """``df`` with ``item_mean`` from a table of :func:`item_means`; unknown
    items get the overall mean."""
    out = salted_join(df, means.drop("item_rows"), keys(item_col), how="left")
    return (attach_group_stats(out, overall, [])
            .withColumn("item_mean", F.coalesce("item_mean", "__overall")).drop("__overall"))
