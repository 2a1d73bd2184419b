"""Column helpers shared by the text operators: words, shingles, reserved
column names and label samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.session import written  # noqa: F401  (the operators take it from here)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\f\r"


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def space_words(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case."""
    flat = F.btrim(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()), F.lit(ASCII_SPACE))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(
        F.split(flat, "[\\x20\\x09-\\x0D]+"))


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of the ``k``-word shingles in text order; a shorter
    sequence is one shingle, none without words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)),
                       lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int"))
                                              for j in range(k)]))
    return (F.when(n >= k, runs)
            .when(n > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (Spark
    compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed_by(df: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the (distinct) keys of
    ``flags``; a null key is never among them."""
    return df.join(flags.select(key).distinct(), key, "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) for learning: labelled documents outside the
    held-out fifth (crc32 of the id as text, modulo 5, is 0), about
    ``bound`` of them at most, chosen by a hash of the id so that the choice
    is the same on every run and every partitioning.  Several label rows of
    one document count as 1 if any of them is 1; null labels don't count."""
    marks = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
             .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = marks.count()
    if n > bound:
        parts = 1_000_000
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(parts))
                            < int(parts * bound / n))
    texts = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return texts.join(marks, "doc_id")


def held_out(doc_id: str) -> Column:
    """True for the fifth of the ids whose labels are never learnt from; a
    null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))
