"""Small shared helpers for operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import materialize


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keys(group_cols: Sequence[str] | str | None) -> list[str]:
    if group_cols is None:
        return []
    if isinstance(group_cols, str):
        return [group_cols]
    return list(group_cols)


# Hot keys: a group may hold a third of all rows.  Joins of raw rows with
# per-group statistics spread each group over this many salt buckets (the
# statistics side, one row per group, is replicated that many times).
SALT_BUCKETS = 8


def row_salt(buckets: int = SALT_BUCKETS) -> Column:
    """Salt in [0, buckets) from the place of the row in its partition, so
    the rows of a key spread over all salts even where they arrive in one
    partition.  (Any salt gives the same result: every salt value meets an
    identical copy of the statistics.)"""
    return F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                   equal: Sequence[str] = ()) -> DataFrame:
    """Equi-join in which a null key equals a null key, with the key columns
    once (the left side's).  Keys in ``equal`` are never null and compare
    plainly."""
    k, renamed = keys(on), {c: f"__right_{i}" for i, c in enumerate(keys(on))}
    other = right.withColumnsRenamed(renamed)
    cond = F.lit(True)
    for c in k:
        theirs = other[renamed[c]]
        cond = cond & (left[c] == theirs if c in equal else left[c].eqNullSafe(theirs))
    return left.join(other, cond, how).drop(*renamed.values())


def salted_join(rows: DataFrame, stats: DataFrame, on: Sequence[str],
                buckets: int = SALT_BUCKETS, how: str = "inner") -> DataFrame:
    """Equi-join of raw ``rows`` with one-row-per-key ``stats`` that stays
    balanced when one key holds a large share of the rows: rows of a key are
    spread over ``buckets`` salt values and ``stats`` is replicated per salt.
    A null key is a key like any other.  (AQE may still turn it into a
    broadcast join when ``stats`` is small, and split what is skewed.)"""
    k = keys(on)
    if buckets <= 1:
        return null_safe_join(rows, stats, k, how)
    salted_rows = rows.withColumn("__salt", row_salt(buckets))
    salted_stats = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return (null_safe_join(salted_rows, salted_stats, [*k, "__salt"], how, equal=["__salt"])
            .drop("__salt"))


def attach_group_stats(df: DataFrame, stats: DataFrame, group_cols: Sequence[str],
                       salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Attach per-group statistics to every row of ``df``.

    With no grouping the statistics are a single row, so it is broadcast (its
    size is one row by construction).  With grouping the statistics have one
    row per group and the join is salted (see :func:`salted_join`), so a
    group holding a third of the rows is still spread over many tasks.
    """
    g = keys(group_cols)
    if not g:
        return df.crossJoin(F.broadcast(stats))
    return salted_join(df, stats, g, salt_buckets)


def with_bucket(df: DataFrame, cuts: str, value, n_cuts: int, out: str) -> DataFrame:
    """Add ``out`` = number of entries of the ascending array column ``cuts``
    (length ``n_cuts``) smaller than ``value``: a fixed-step binary search
    over ``element_at``, one projected column per step (log2 steps,
    code-generated, no per-element lambda)."""
    step = 1
    while step * 2 <= n_cuts:
        step *= 2
    cur = "__pos0"
    df = df.withColumn(cur, F.lit(0))
    i = 0
    while step >= 1:
        i += 1
        nxt = F.col(cur) + step
        probe = F.element_at(F.col(cuts), F.least(nxt, F.lit(n_cuts)))
        df = df.withColumn(f"__pos{i}", F.when((nxt <= n_cuts) & (probe < value), nxt)
                           .otherwise(F.col(cur)))
        df = df.drop(cur)
        cur = f"__pos{i}"
        step //= 2
    return df.withColumnRenamed(cur, out)


ROWS_PER_RANGE = 1_000_000


def range_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                out: str = "idx", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """0-based position of each row in the order of ``order_cols`` (unique
    within a group) inside its group, for any type of order.

    The measured number of rows decides how many ranges the table is cut
    into; Spark samples where they end.  A task numbers one range, and the
    rows of the ranges before it, counted for each group, are its offset.  So
    no task sorts a whole group, whatever the values share."""
    g = keys(group_cols)
    rows = materialize(df)
    ranges = -(-rows.count() // rows_per_range)
    if ranges <= 1:
        w = Window.partitionBy(*g).orderBy(*order_cols)
        return rows.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    # written once: the ranges must not move between the two reads
    rows = materialize(rows.repartitionByRange(ranges, *g, *order_cols)
                       .withColumn("__range", F.spark_partition_id()))
    sizes = rows.groupBy(*g, "__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*g).orderBy("__range")
                              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*g, "__range").orderBy(*order_cols)) - 1
    return (null_safe_join(rows.withColumn("__inside", inside), sizes, [*g, "__range"],
                           equal=["__range"])
            .withColumn(out, (F.col("__ahead") + F.col("__inside")).cast("long"))
            .drop("__range", "__inside", "__ahead"))


def with_calendar_bucket(df: DataFrame, order_col: str, out: str = "__coarse") -> DataFrame:
    """Add a coarse bucket that never decreases as ``order_col`` grows: the
    year of a date, the day of a timestamp."""
    t = dict(df.dtypes)[order_col]
    if t == "date":
        return df.withColumn(out, F.year(order_col))    # <= 366 distinct days a year
    if t.startswith("timestamp"):
        return df.withColumn(out, F.to_date(order_col))  # one bucket per calendar day
    raise TypeError(f"no calendar bucket for {t}")


def ordered_index(df: DataFrame, order_col: str, group_cols: Sequence[str],
                  coarse: Column | None = None, out: str = "idx",
                  tie_cols: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in ``order_col`` order within ``group_cols``.

    ``(order_col, *tie_cols)`` must be unique within a group.  The
    index is computed in two levels so that no single task has to number a
    whole group: rows are numbered by a window partitioned on
    ``group_cols + coarse`` (``coarse`` must never decrease as ``order_col``
    grows, such as the year of a date; that of dates and timestamps by
    default, all else goes by :func:`range_index`), and each coarse bucket gets an offset from a running count over
    the per-bucket table, which has one row per group x bucket.
    """
    g = keys(group_cols)
    kind = dict(df.dtypes)[order_col]
    if coarse is None and kind != "date" and not kind.startswith("timestamp"):
        return range_index(df, [order_col, *tie_cols], g, out)
    if coarse is None:
        tmp = with_calendar_bucket(df, order_col)
    else:
        tmp = df.withColumn("__coarse", coarse)
    local = tmp.withColumn(
        "__local", F.row_number().over(
            Window.partitionBy(*g, "__coarse").orderBy(order_col, *tie_cols)) - 1)
    sizes = tmp.groupBy(*g, "__coarse").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn(
        "__offset",
        F.coalesce(F.sum("__n").over(
            Window.partitionBy(*g).orderBy("__coarse")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (null_safe_join(local, offsets.drop("__n"), [*g, "__coarse"])
            .withColumn(out, (F.col("__local") + F.col("__offset")).cast("long"))
            .drop("__coarse", "__local", "__offset"))
