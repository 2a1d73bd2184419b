"""CSV records bound by their own file's header, in one plan for any number
of headers, alike for a batch and for a stream.

The files are read as text lines, which Spark splits among tasks.  A record is
a line, or several where a quoted field holds line breaks: a line belongs to
the record of the line before it if the quotes up to there are odd.  Quotes
are counted by block of a file, so only files with such fields are numbered,
and none of them by one task.  The first record of a file is its header; it is
joined to the file's other records, and each becomes a row with a map from
column name to text.

Files follow RFC 4180: fields with commas, quotes or line breaks are quoted,
quotes inside are doubled.  Line breaks inside fields come back as ``\\n``.
Missing-value tokens are null.  Names of a header that repeat get `` #2``,
`` #3`` and so on; empty ones are ``Unnamed: <place>``.  Empty lines are no
records.  A row with fewer fields than its header lacks the last ones (null);
fields beyond the header are dropped.  A file without rows gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators._util import null_safe_join, salted_join
from mercato.session import written

# Strings read as missing (the pandas CSV reader's defaults).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Only files ending in .csv (any case) are uploads.
CSV_GLOB = "*.[cC][sS][vV]"

_PLACE = ["upload_file", "block"]


def _located(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("upload_file"),
                        F.col("_metadata.file_block_start").alias("block"))


def file_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, upload_file, block) of all CSV files under ``paths``."""
    return _located(spark.read.option("pathGlobFilter", CSV_GLOB).text(paths))


def line_stream(spark: SparkSession, source_dir: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """The same for newly arriving files."""
    r = spark.readStream.format("text").schema("value string").option("pathGlobFilter", CSV_GLOB)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _located(r.load(source_dir))


def _count(text: str, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))


def records(lines: DataFrame) -> DataFrame:
    """(upload_file, block, at, value): the records of each file; (block,
    at) orders them."""
    # lines of a block are read in order by one task; they are written once,
    # so that every later step sees the same places
    placed = written(lines.withColumns({"at": F.monotonically_increasing_id(),
                                        "odd": _count("value", '"') % 2}))
    plain = placed.select(*_PLACE, "at", "value").where(F.trim("value") != "")
    blocks = placed.groupBy(*_PLACE).agg(F.sum("odd").alias("odds"))
    by_file = Window.partitionBy("upload_file")
    before = F.sum("odds").over(by_file.orderBy("block")
                                .rowsBetween(Window.unboundedPreceding, -1))
    broken = written(blocks.select(*_PLACE, F.coalesce(before, F.lit(0)).alias("before"),
                                   F.sum("odds").over(by_file).alias("all"))
                     .where(F.col("all") > 0).drop("all"))
    if broken.isEmpty():
        return plain
    joined = salted_join(placed, broken, _PLACE, how="left")
    plain = (joined.where("before IS NULL").select(*_PLACE, "at", "value")
             .where(F.trim("value") != ""))
    w = Window.partitionBy(*_PLACE).orderBy("at")
    odds = F.sum("odd").over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.coalesce(odds, F.lit(0)) + F.col("before")) % 2 == 1
    starts = F.max("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = (joined.where("before IS NOT NULL").withColumn("inside", inside)
             .withColumn("start", F.when(~F.col("inside"), F.col("at")))
             .withColumn("start", starts))
    # the lines of a record that are in one block, without a further shuffle
    pieces = written(
        parts.groupBy(*_PLACE, "start")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines"))
        .select(*_PLACE, "start", _joined_lines("lines").alias("value")))
    # the record that a block begins inside of started in an earlier block
    lasts = pieces.groupBy(*_PLACE).agg(F.max("start").alias("at"))
    earlier = F.max(F.when(F.col("at").isNotNull(), F.struct("block", "at"))).over(
        by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(*_PLACE, earlier.alias("earlier"))
    tails = written(
        null_safe_join(pieces.where("start IS NULL"), lasts, _PLACE)
        .groupBy("upload_file", "earlier")
        .agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("lines"))
        .select("upload_file", "earlier.block", F.col("earlier.at").alias("start"),
                _joined_lines("lines").alias("tail")))
    whole = salted_join(pieces.where("start IS NOT NULL"), tails, [*_PLACE, "start"], how="left")
    return plain.union(
        whole.select(*_PLACE, F.col("start").alias("at"),
                     F.concat_ws("\n", "value", "tail").alias("value"))
        .where(F.trim("value") != ""))


def _joined_lines(lines: str) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["value"]), "\n")


def _with_fields(rows: DataFrame, value: str, width: int) -> DataFrame:
    """``rows`` with the first ``width`` fields of a record as the array
    ``fields``.  The parsed record is a column of its own: inside the array it
    would be parsed again for every field."""
    schema = ", ".join(f"f{i} string" for i in range(width))
    parsed = F.from_csv(F.col(value), F.lit(schema),
                        {"quote": '"', "escape": '"', "mode": "PERMISSIVE",
                         "maxColumns": str(width + 1), "maxCharsPerColumn": "-1",
                         "multiLine": "true"})
    return (rows.withColumn("__parsed", parsed)
            .withColumn("fields", F.array(*[F.col("__parsed")[f"f{i}"] for i in range(width)]))
            .drop("__parsed"))


def _unique_names(names: Column) -> Column:
    named = F.transform(names, lambda x, i: F.coalesce(
        F.when(F.trim(x) != "", x), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    return F.transform(named, lambda x, i: F.concat(x, F.when(
        F.array_position(named, x) <= i,
        F.concat(F.lit(" #"), (F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x)) + 1)
                 .cast("string"))).otherwise("")))


def without_missing(text: Column) -> Column:
    """Missing-value tokens -> null."""
    return F.when(~text.isin(*NA_TOKENS), text)


def headers(rows: DataFrame) -> DataFrame:
    """(upload_file, first, names) of :func:`records`: where the header of
    each file is, and its column names.  One number reaches the driver, the
    width of the widest header."""
    # places first, by block and then by file, and their texts by a join: the
    # least of structs with texts would sort all rows
    firsts = written(rows.groupBy(*_PLACE).agg(F.min("at").alias("at")).groupBy("upload_file")
                     .agg(F.min(F.struct("block", "at")).alias("first"))
                     .select("upload_file", "first.*"))
    first = null_safe_join(rows, firsts, [*_PLACE, "at"], equal=["block", "at"])
    first = written(first.withColumn("header", F.regexp_replace("value", "^\ufeff", ""))
                    .withColumn("unquoted", F.regexp_replace("header", '"[^"]*"', ""))
                    .withColumn("n", _count("unquoted", ",") + 1)
                    .select("upload_file", F.struct("block", "at").alias("first"), "header", "n"))
    width = first.agg(F.max("n")).first()[0] or 1
    return written(_with_fields(first, "header", width).select(
        "upload_file", "first",
        _unique_names(F.slice("fields", F.lit(1), F.col("n"))).alias("names")))


def with_cells(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(upload_file, upload_id, block, at, cells, beyond) of the rows below
    the headers: ``cells`` is a MAP<column, text> in the header's order, and
    ``beyond`` says that the row has a field that its header lacks."""
    width = (named.agg(F.max(F.size("names"))).first()[0] or 1) + 1
    joined = salted_join(rows, named, ["upload_file"])
    joined = _with_fields(joined.where(F.struct("block", "at") != F.col("first")), "value", width)
    joined = joined.withColumn("fields", F.transform("fields", without_missing))
    return joined.select(
        "upload_file", F.xxhash64("upload_file").alias("upload_id"), "block", "at",
        F.map_from_arrays("names", F.slice("fields", F.lit(1), F.size("names"))).alias("cells"),
        F.exists(F.slice("fields", F.size("names") + 1, F.lit(width)), F.isnotnull).alias("beyond"))


def with_row_numbers(cell_rows: DataFrame, out: str = "row", upload: str = "upload_file"
                     ) -> DataFrame:
    """``cell_rows`` with the place of each row in its upload, from 0: a file,
    or all files with the same ``upload`` in the order of their paths.
    Counted by block, numbered inside each block, so that no file is one
    task's: by the places themselves where a block's rows follow one another,
    and sorted only where records of several lines or empty ones leave gaps."""
    blocks = written(cell_rows.groupBy(upload, *[c for c in _PLACE if c != upload]).agg(
        F.count(F.lit(1)).alias("__n"), F.min("at").alias("__low"), F.max("at").alias("__high")))
    ahead = F.sum("__n").over(Window.partitionBy(upload).orderBy(*_PLACE)
                              .rowsBetween(Window.unboundedPreceding, -1))
    blocks = written(blocks.select(
        *_PLACE, "__low", F.coalesce(ahead, F.lit(0)).alias("__ahead"),
        (F.col("__high") - F.col("__low") + 1 == F.col("__n")).alias("__dense")))
    rows = salted_join(cell_rows, blocks, _PLACE)

    def numbered(part: DataFrame, inside: Column) -> DataFrame:
        return (part.withColumn(out, (F.col("__ahead") + inside).cast("long"))
                .drop("__low", "__ahead", "__dense"))

    dense = numbered(rows.where("__dense"), F.col("at") - F.col("__low"))
    if blocks.where("NOT __dense").isEmpty():
        return dense
    place = F.row_number().over(Window.partitionBy(*_PLACE).orderBy("at")) - 1
    return dense.union(numbered(rows.where("NOT __dense"), place))


def cells(lines: DataFrame) -> DataFrame:
    """:func:`with_cells` of text lines."""
    rows = records(lines)
    return with_cells(rows, headers(rows))


def column_names(named: DataFrame) -> list[str]:
    """The names of all headers, by place and then by name: a schema, which
    is the driver's to decide."""
    places = (named.select(F.posexplode("names").alias("place", "name"))
              .groupBy("name").agg(F.min("place").alias("place")))
    return [r["name"] for r in sorted(places.collect(), key=lambda r: (r["place"], r["name"]))]


def bound(cell_rows: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns of ``schema`` by name (null where a file lacks one or a value
    doesn't parse), with upload_file and upload_id."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return cell_rows.select(*[
        F.col("cells")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields],
        "upload_file", "upload_id")
