"""Connected components by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.text import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node
    of its component.

    Every node starts as its own label.  In a round each node takes the
    label of the smallest label among its neighbours' and its own, which
    hooks it onto a neighbour and follows that one's pointer at once, so
    long chains shorten by jumps.  No label ever exceeds its node, so once
    no label changes they are equal along every edge and the smallest.  A
    round is one job, written to the shared folder; a hub only
    ever meets a minimum, which aggregates before the shuffle."""
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(one_way.select(F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")),
        F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v"))).alias("e"))
        .select("e.*").distinct())
    labels = both.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    while True:
        known = labels.select(F.col("node").alias("v"), F.col("root").alias("label"))
        least = both.join(known, "v").groupBy("u").agg(
            F.min("label").alias("least"),
            F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old"))
        jump = labels.select(F.col("node").alias("least"), "root")
        state = written(least.join(jump, "least").select(
            F.col("u").alias("node"), "root", (F.col("root") != F.col("old")).alias("changed")))
        labels = state.select("node", "root")
        if state.where("changed").isEmpty():
            return labels
