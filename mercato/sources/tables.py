"""Parquet table access for the analytic tables (orders, lineitem, ...)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Attribute access to the tables of one data folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self._spark, self._dir, name)


def with_row_index(df: DataFrame, out: str = "row_index") -> DataFrame:
    """Position of each row inside its Parquet file (0-based), from the
    file metadata: stable across runs and retries, no shuffle, no sort."""
    return df.select("*", F.col("_metadata.row_index").alias(out),
                     F.col("_metadata.file_path").alias(f"{out}_file"))
