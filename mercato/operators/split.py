"""Exact stratified splits by hash.

Every class (a label within its groups) is ordered by the MD5 of the row
key.  The first ``test_percent`` of its rows (rounded half up) are the test
part, the next ``validation_percent`` the validation part, the rest train.
The order is the same on every run and every partitioning, SQL can compute
it, and rows that share a key always fall into the same part.

No class is sorted as a whole.  Counts for each leading part of the hash
(4,096 places) find the place in which a part ends; only the rows of that
place are ranked, which gives the hash at which the part ends.  The rows then
compare their own hash with the ends of their class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators._util import attach_group_stats, keys, null_safe_join

PLACE_DIGITS = 3          # leading hex digits of a hash: 4,096 places of a class


def key_hash(key: str | Column) -> Column:
    """Hex MD5 of a key as text; a null key is the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hash_part(key: str | Column, parts: int) -> Column:
    """0 .. parts - 1 from the first seven hex digits of the key's hash."""
    return F.conv(F.substring(key_hash(key), 1, 7), 16, 10).cast("long") % parts


def quota(n: Column, percent: int) -> Column:
    """``percent`` of ``n`` rows, rounded half up."""
    return F.floor((n * percent + 50) / 100).cast("long")


def part_ends(rows: DataFrame, classes: Sequence[str], test_percent: int,
              validation_percent: int) -> DataFrame:
    """(classes..., test_end, validation_end) from (classes..., h): the
    largest hash of the test part and of test and validation together, null
    where a part has no rows."""
    c = keys(classes)
    place = F.substring("h", 1, PLACE_DIGITS)
    counts = rows.groupBy(*c, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*c)
    ahead = F.sum("n").over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(w)
    placed = counts.select(*c, "place", "n", F.coalesce(ahead, F.lit(0)).alias("ahead"),
                           quota(total, test_percent).alias("test"),
                           quota(total, test_percent + validation_percent).alias("both"))
    inside = [(F.col("ahead") < F.col(end)) & (F.col(end) <= F.col("ahead") + F.col("n"))
              for end in ("test", "both")]
    cut = placed.where(inside[0] | inside[1]).drop("n")
    near = null_safe_join(rows.withColumn("place", place), cut, [*c, "place"], equal=["place"])
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy(*c, "place").orderBy("h"))
    return (near.withColumn("rank", rank).groupBy(*c)
            .agg(F.max(F.when(F.col("rank") == F.col("test"), F.col("h"))).alias("test_end"),
                 F.max(F.when(F.col("rank") == F.col("both"), F.col("h"))).alias("validation_end")))


def stratified_split(df: DataFrame, key_col: str, label_col: str,
                     group_cols: Sequence[str] = (), test_percent: int = 20,
                     validation_percent: int = 0, out: str = "split") -> DataFrame:
    """``df`` with ``out``: test, validation or train, in exact shares of
    each label (null is one) within each group."""
    c = [*keys(group_cols), label_col]
    hashed = df.withColumn("__h", key_hash(key_col))
    every = hashed.select(*c).distinct()
    ends = null_safe_join(every, part_ends(hashed.select(*c, F.col("__h").alias("h")), c,
                                           test_percent, validation_percent), c, "left")
    joined = attach_group_stats(hashed, ends.withColumnsRenamed(
        {"test_end": "__test", "validation_end": "__validation"}), c)
    part = (F.when(F.col("__h") <= F.col("__test"), "test")
            .when(F.col("__h") <= F.col("__validation"), "validation").otherwise("train"))
    return joined.withColumn(out, part).drop("__h", "__test", "__validation")
