"""Types and roles of columns, decided for each upload from its own cells.

Uploads share a table although their columns differ: a row holds its cells
as a MAP<column, text>.  One aggregate over the cells gives the decision
table (upload, column -> type, parse rate, variance); the date and the
quantity column of an upload are chosen from it by joins, so that no upload's
names or bad values change another's, and nothing about single uploads
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.coerce import number_shaped, parses_as
from mercato.operators._util import null_safe_join
from mercato.operators.clean import DATE_NAME_WORDS
from mercato.operators.roles import DATE_KEYWORDS, QUANTITY_KEYWORDS

NUMBERS = ("long", "double")


def long_cells(rows: DataFrame, upload_col: str = "upload_id", cells: str = "cells") -> DataFrame:
    """(upload, place, field, text): a row for each cell; ``place`` is that of
    the column in its upload's header."""
    return (rows.select(upload_col, F.posexplode(F.map_entries(cells)).alias("place", "cell"))
            .select(upload_col, "place", F.col("cell.key").alias("field"),
                    F.trim("cell.value").alias("text")))


def _contains(name: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(name, F.lit(word))
    return hit


def column_decisions(cells: DataFrame, upload_col: str = "upload_id") -> DataFrame:
    """One row for each (upload, field) of :func:`long_cells`: place, rows,
    n (values that are there), kind, parse_rate (share of values that are
    timestamps; texts only), variance and mean (numbers only).

    kind: ``missing`` without values; ``datetime`` if the name says so;
    ``long`` or ``double`` if every value is one; else ``string``."""
    x, some, number = F.col("text"), F.col("text").isNotNull(), F.col("number")
    # one cast for each cell, none for what has not the shape of a number
    cells = cells.withColumn("number", F.when(number_shaped(x), x.try_cast("double")))
    dated = _contains(F.lower("field"), DATE_NAME_WORDS)
    table = cells.groupBy(upload_col, "field").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"),
        F.bool_and(~some | parses_as(x, "long")).alias("longs"),
        F.bool_and(~some | number.isNotNull()).alias("doubles"),
        F.count(F.try_to_timestamp(x)).alias("dates"),
        F.var_samp(number).alias("variance"), F.avg(number).alias("mean"))
    kind = (F.when(F.col("n") == 0, "missing").when(dated, "datetime").when(F.col("longs"), "long")
            .when(F.col("doubles"), "double").otherwise("string"))
    is_number = F.col("kind").isin(*NUMBERS)
    return table.withColumn("kind", kind).select(
        upload_col, "field", "place", "rows", "n", "kind",
        F.when(F.col("kind").isin("datetime", "string"), F.col("dates") / F.col("n"))
        .alias("parse_rate"),
        F.when(is_number, F.col("variance")).alias("variance"),
        F.when(is_number, F.col("mean")).alias("mean"))


def upload_roles(decisions: DataFrame, upload_col: str = "upload_id", strict: bool = True
                 ) -> DataFrame:
    """One row for each upload: record_count, column_count, date_column,
    quantity_column (null if there is none) and quantity_kind.

    A column is chosen by its name (exact keyword, then substring, in the
    header's order), else a date by its values (all of them timestamps) and a
    quantity by the largest variance.  ``strict`` lets only date-like and
    numeric columns win by name."""
    name = F.lower(F.trim("field"))
    date_like = (F.col("kind") == "datetime") | ((F.col("kind") == "string")
                                                 & (F.col("parse_rate") >= 1.0))
    number = F.col("kind").isin(*NUMBERS)

    def choice(words: Sequence[str], fits: Column, by_value: Column, order: Column) -> Column:
        named = fits if strict else F.lit(True)
        rank = (F.when(named & name.isin(*words), 0).when(named & _contains(name, words), 1)
                .when(by_value, 2))
        return F.min(F.when(rank.isNotNull(), F.struct(
            rank.alias("rank"), F.when(rank == 2, order).otherwise(0.0).alias("order"), "place",
            "field", "kind")))

    return decisions.groupBy(upload_col).agg(
        F.max("rows").alias("record_count"), F.count(F.lit(1)).alias("column_count"),
        choice(DATE_KEYWORDS, date_like, date_like, F.lit(0.0)).alias("d"),
        choice(QUANTITY_KEYWORDS, number, number & F.col("variance").isNotNull(),
               -F.col("variance")).alias("q")).select(
        upload_col, "record_count", "column_count", F.col("d.field").alias("date_column"),
        F.col("q.field").alias("quantity_column"), F.col("q.kind").alias("quantity_kind"))


def fill_table(cells: DataFrame, decisions: DataFrame, upload_col: str = "upload_id") -> DataFrame:
    """(upload, field, kind, mean, mode): what a missing cell is filled with,
    the mean of numbers, the most frequent text (ties: the smallest) of
    others."""
    counts = (cells.where("text IS NOT NULL").groupBy(upload_col, "field", "text")
              .agg(F.count(F.lit(1)).alias("n")))
    modes = (counts.groupBy(upload_col, "field")
             .agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("m"))
             .select(upload_col, "field", F.col("m.text").alias("mode")))
    return null_safe_join(decisions.select(upload_col, "field", "kind", "mean"), modes,
                          [upload_col, "field"], "left", equal=["field"])
