"""Context-triggered piecewise fingerprints of documents.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its low
bits are all ones, so a boundary depends on the bytes around it and an edit
moves only the chunks it touches.  The block size (mean chunk length) is the
power of two that gives a text at most ``LENGTH`` chunks on average.  A
fingerprint ``size:one:two`` has one character for each chunk at that block
size, and at twice that size.  As in other piecewise hashes, the last of
``LENGTH`` characters stands for all the rest, so a text of one repeated
byte has a short fingerprint too; every byte counts.

Two fingerprints compare by the edit distance of their signatures at the
block size they share (equal, or one twice the other): 1 less the distance
over the longer length, and 0 where no size is shared.  Equal texts have
equal fingerprints, of likeness 1; nulls count as empty texts, with the
fingerprint of no chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators._util import with_bucket
from mercato.session import ship_package

WINDOW = 7
LENGTH = 64
LEAST_BLOCK = 1
# Base 64 in its usual order.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hash of each byte with the ``WINDOW - 1`` bytes before it."""
    total = np.zeros(len(data), np.uint32)
    weight = np.uint32(1)
    for back in range(min(WINDOW, len(data))):
        total[back:] += (data[:len(data) - back].astype(np.uint32) + np.uint32(1)) * weight
        weight = np.uint32(int(weight) * 0x01000193 & 0xFFFFFFFF)
    total *= np.uint32(0x9E3779B1)
    return total >> np.uint32(8)


def signature(raw: bytes, marks: np.ndarray, block: int) -> str:
    """One character for each chunk of ``raw`` that ends where a mark has
    all bits below ``block`` set; the last of ``LENGTH`` takes the rest."""
    ends = (np.flatnonzero((marks & np.uint32(block - 1)) == block - 1)[:LENGTH - 1] + 1).tolist()
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    start, out = 0, []
    for end in ends[:-1]:
        out.append(LETTERS[zlib.crc32(raw[start:end]) >> 26])
        start = end
    out.append(LETTERS[zlib.crc32(raw[start:]) >> 26])
    return "".join(out)


def fingerprint_bytes(raw: bytes) -> str:
    if not raw:
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * LENGTH < len(raw):
        block *= 2
    marks = rolling(np.frombuffer(raw, np.uint8))
    return f"{block}:{signature(raw, marks, block)}:{signature(raw, marks, 2 * block)}"


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_bytes(t.as_py().encode()) for t in texts], pa.string())


def fingerprint(text: str | Column) -> Column:
    return _fingerprint(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def _alike(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns, from 0 to 1."""
    x, y = F.split(F.col(a), ":"), F.split(F.col(b), ":")
    size_x, size_y = x[0].cast("long"), y[0].cast("long")
    score = (F.when(size_x == size_y, F.greatest(_alike(x[1], y[1]), _alike(x[2], y[2])))
             .when(size_x == 2 * size_y, _alike(x[1], y[2]))
             .when(size_y == 2 * size_x, _alike(x[2], y[1]))
             .otherwise(F.lit(0.0)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(score)


def with_next(df: DataFrame, order: str, columns: dict[str, str], tie: str,
              derive: dict[str, Column] | None = None,
              rows_per_bucket: int = 1000, most_buckets: int = 10_000) -> DataFrame:
    """Add, for each row, columns of the row that follows it by ``order``
    (ties by ``tie``; after the last row comes the first).  ``columns`` maps
    a column to the name its next value gets; ``derive`` adds columns that
    it may name, made once for each row.

    No task sorts the whole table: rows fall into buckets by quantiles of
    ``order``, each bucket is a window of its own, and gets a copy of the
    first row of the next bucket that has rows.  Those copies are one row
    for each bucket, found by the ``most_buckets`` ids at most that are
    broadcast."""
    ship_package(df.sparkSession)
    derive = derive or {}
    n = df.count()
    if n == 0:
        df = df.withColumns(derive)
        return df.withColumns({new: F.lit(None).cast(dict(df.dtypes)[old])
                               for old, new in columns.items()})
    buckets = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    # buckets are cut by the value as a double, which never falls as the value
    # grows; the order inside them is that of the value itself, null first
    rough = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    keyed = df.withColumns({"__rough": rough, "__order": F.struct(
        F.col(order).isNotNull().alias("there"), F.col(order).alias("value"))})
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), probs, 10 * buckets)
                      .alias("cuts")).first().cuts
    else:
        cuts = None
    if cuts:
        keyed = with_bucket(keyed.withColumn("__cuts", F.array(*[F.lit(c) for c in cuts]))
                            if len(cuts) <= 64 else
                            keyed.crossJoin(F.broadcast(df.sparkSession.createDataFrame(
                                [(cuts,)], "__cuts array<double>"))),
                            "__cuts", F.col("__rough"), len(cuts), "__bucket").drop("__cuts")
    else:
        keyed = keyed.withColumn("__bucket", F.lit(0))
    keyed = keyed.drop("__rough")
    firsts = [r for r in keyed.groupBy("__bucket").agg(F.min("__order").alias("first"))
              .orderBy("__bucket").collect()]           # one small row for each bucket
    goes_to = [(firsts[(i + 1) % len(firsts)]["first"], r["__bucket"])
               for i, r in enumerate(firsts)]
    kind = dict(df.dtypes)[order]
    heads = df.sparkSession.createDataFrame(
        goes_to, f"__order struct<there:boolean,value:{kind}>, __to int")
    first_of = Window.partitionBy("__bucket").orderBy(F.col(tie).asc_nulls_first())
    heads = heads.withColumnRenamed("__order", "__first")
    tail = (keyed.join(F.broadcast(heads), keyed["__order"].eqNullSafe(heads["__first"]))
            .drop("__first")
            .withColumn("__at", F.row_number().over(first_of)).where("__at = 1")
            .withColumn("__bucket", F.col("__to")).drop("__to", "__at")
            .withColumn("__extra", F.lit(1)))
    both = keyed.withColumn("__extra", F.lit(0)).unionByName(tail).withColumns(derive)
    w = Window.partitionBy("__bucket").orderBy("__extra", "__order", F.col(tie).asc_nulls_first())
    return (both.withColumns({new: F.lead(old).over(w) for old, new in columns.items()})
            .where("__extra = 0").drop("__extra", "__order", "__bucket"))
