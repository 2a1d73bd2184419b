"""CSV records by header against Python's csv module."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from mercato.sources import records, uploads


def read(spark, folder):
    rows = records.cells(records.file_lines(spark, str(folder))).orderBy("upload_file", "block", "at")
    found = {}
    for r in rows.collect():
        found.setdefault(os.path.basename(r["upload_file"]), []).append(r["cells"])
    return found


def expected(text):
    header, *rows = [r for r in csv.reader(io.StringIO(text)) if r and r != [" "]]
    rows = [r + [""] * len(header) for r in rows]
    return [{n: None if v in records.NA_TOKENS else v for n, v in zip(header, r, strict=False)}
            for r in rows]


def made(r, names, n):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    for _ in range(n):
        w.writerow([r.choice(["plain", "12", "NA", "", 'a "b"', "x, y", "two\nlines", "é\n\n\"q\"\n",
                              " padded "]) + r.choice(["", "z"]) for _ in names])
    return out.getvalue()


@pytest.mark.parametrize("block", ["128m", "97", "1k"])
def test_any_headers_and_blocks(spark, tmp_path, block):
    """Files of other headers, some with line breaks in fields, read whole
    and cut into blocks that start anywhere."""
    r = random.Random(4)
    files = {f"f{i}.csv": made(r, r.sample(["sku", "price", "qty", "say, \"x\"", "d\ne"], k), n)
             for i, (k, n) in enumerate([(1, 3), (3, 40), (5, 25), (2, 1)])}
    files["plain.CSV"] = "qty,sku\n1,a\n2,b\n\n3,c\n"
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "other.txt").write_text("no,upload\n1,2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = read(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: expected(text) for name, text in files.items()}


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿sku,qty,sku,,sku\n1,2,3,4,5\nshort\n1,2,3,4,5,beyond\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text('sku,"b,c"')
    (tmp_path / "win.csv").write_text("sku,qty\r\n7,8\r\n")
    got = read(spark, tmp_path)
    names = ["sku", "qty", "sku #2", "Unnamed: 3", "sku #3"]
    assert got == {"a.csv": [dict(zip(names, "12345", strict=True)),
                             dict.fromkeys(names) | {"sku": "short"},
                             dict(zip(names, "12345", strict=True))],
                   "win.csv": [{"sku": "7", "qty": "8"}]}
    df = uploads.read_uploads(spark, str(tmp_path))
    assert df.columns == ["sku", "b,c", "qty", "sku #2", "Unnamed: 3", "sku #3", "upload_file",
                          "upload_id"]
    typed = uploads.read_uploads(spark, str(tmp_path), schema="qty int, sku string, none double")
    assert sorted((r["qty"], r["sku"], r["none"]) for r in typed.where("qty IS NOT NULL").collect()
                  ) == [(2, "1", None), (2, "1", None), (8, "7", None)]


@pytest.mark.parametrize("block", ["128m", "101"])
def test_rows_are_numbered_in_their_file(spark, tmp_path, block):
    for name, n in (("a.csv", 70), ("b.csv", 1)):
        lines = "".join(f'{i},"x\n{i}"\n' for i in range(n))
        (tmp_path / name).write_text("place,note\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = records.with_row_numbers(records.cells(records.file_lines(spark, str(tmp_path))))
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 71 and all(int(r["cells"]["place"]) == r["row"] for r in got)
    assert not any(r["beyond"] for r in got)


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read(spark, tmp_path) == {}
    assert uploads.read_uploads(spark, str(tmp_path)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_rows_are_read_and_numbered_without_a_shuffle(spark, tmp_path):
    """No join, sort or window moves the rows of files without line breaks
    in fields: small tables of files and blocks go to them."""
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("a,b,c\n" + "".join(f"{n},{i},x\n" for n in range(50)))
    cells = records.cells(records.file_lines(spark, str(tmp_path)))
    numbered = records.with_row_numbers(cells)
    plan = _plan(numbered)
    assert not any(step in plan for step in ("hashpartitioning", "SortMergeJoin", "Window", "Sort"))
    assert plan.count("from_csv") == 1          # a record is parsed once, not for each field
    assert sorted((r["cells"]["b"], int(r["cells"]["a"]), r["row"]) for r in numbered.collect()
                  ) == [(str(i), n, n) for i in range(3) for n in range(50)]


def test_line_breaks_take_one_shuffle_of_the_lines(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f'{n},"x\n{n}"\n' for n in range(50)))
    rows = records.records(records.file_lines(spark, str(tmp_path)))
    assert "Window" not in _plan(rows) and "hashpartitioning" not in _plan(rows)
    assert rows.count() == 51


@pytest.mark.parametrize("block", ["128m", "41"])
def test_rows_are_numbered_through_the_files_of_an_upload(spark, tmp_path, block):
    """Three files are one upload; empty lines are no rows, and a file
    without rows counts none."""
    parts = {"p-0.csv": "n\n0\n\n1\n2\n", "p-1.csv": "n\n", "p-2.csv": "m,n\n,3\n,4\n\n\n,5\n",
             "q-0.csv": "n\n0\n"}
    for name, text in parts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        cells = records.cells(records.file_lines(spark, str(tmp_path)))
        cells = cells.withColumn("upload", F.regexp_extract("upload_file", "([pq])-", 1))
        got = records.with_row_numbers(cells, upload="upload").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["upload"], r["row"], r["cells"]["n"]) for r in got) == [
        ("p", i, str(i)) for i in range(6)] + [("q", 0, "0")]
