"""The paged CSV export and its metadata."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: The columns of the two files.
PAGE_COLUMNS = ["DOCUMENT_ID", "TITLE", "QUICK_CODE", "FOLDER_MINI_FULL_PATH", "LAST_MODIFIED_DATETIME", "PAGE_INDEX", "PAGE_CONTENT", "RELATIVE_PATH"]
PAGE_OPTIONAL = ["LANGUAGE"]
INDEX_COLUMNS = ["DOCUMENT_ID", "DOCUMENT_TYPE_NAME", "SUMMARY", "VERSION", "CHECK_DATE", "ATTENTION_REQUIRED_FLAGS"]
INDEX_OPTIONAL = ["REVISION", "ACTIVE"]
MAX_FAILURES = 25


class HeaderError(ValueError):
    """The file's header breaks the contract."""


def read_header(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """The header's names in upper case, or an error: encoding, delimiter, duplicates, missing, in this order."""
    line = spark.read.text(path).limit(1).collect()
    text = line[0][0] if line else ""
    if "�" in text or "\x00" in text:
        raise HeaderError("the file is not UTF-8")
    names = [n.strip().upper() for n in next(csv.reader([text.removeprefix("﻿")]), [])]
    if len(names) <= 1:
        raise HeaderError("a single column: is the delimiter a comma?")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise HeaderError("duplicate columns: " + ", ".join(twice))
    if missing := [n for n in required if n not in names]:
        raise HeaderError("missing columns: " + ", ".join(missing))
    return names


def read_rows(spark: SparkSession, path: str, required: list[str], optional: list[str]) -> DataFrame:
    """All cells as strings, with ``row_no`` (the header is row 1) and ``unreadable``; lost columns are null.

    One file is read in order by one task (quoted cells may span lines), so
    numbers are those of the file.
    """
    names = read_header(spark, path, required)
    schema = ", ".join(f"`{n}` string" for n in names) + ", `_corrupt_record` string"
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", encoding="UTF-8")
    rows = rows.withColumn("row_no", F.monotonically_increasing_id() + 2).withColumn("unreadable", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")
    taken = [F.col(n).alias(n.lower()) for n in required] + [(F.col(n) if n in names else F.lit(None).cast("string")).alias(n.lower()) for n in optional]
    return rows.select("row_no", "unreadable", *taken)


def longest_failure(rows: DataFrame) -> int:
    """The longest run of unreadable rows."""
    island = F.col("row_no") - F.row_number().over(Window.orderBy("row_no"))  # unreadable rows of one file
    runs = rows.where("unreadable").withColumn("island", island).groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("document_id")).alias("size"))
    return runs.agg(F.max("n"), F.max("size")).first()[0] or 0  # the second keeps a parsed column in the scan, which Spark asks for


def _with_error(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    error = F.when(F.col("unreadable"), "unreadable row").when(scalar.blank(F.col("document_id")), "DOCUMENT_ID is missing")
    for bad, message in checks:
        error = error.when(bad, message)
    return rows.withColumn("error", error).withColumn("document_id", scalar.trimmed(F.col("document_id"))).drop("unreadable")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages with ``error`` (null: a record)."""
    rows = read_rows(spark, path, PAGE_COLUMNS, PAGE_OPTIONAL)
    if longest_failure(rows) >= MAX_FAILURES:
        raise ValueError(f"{MAX_FAILURES} unreadable rows in a row in {path}")
    number = scalar.strict_int(F.col("page_index"))
    return _with_error(rows, [(number.isNull(), "PAGE_INDEX is no number")]).withColumn("page_index", number)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, INDEX_COLUMNS, INDEX_OPTIONAL)
    value, bad = scalar.active_flag(F.col("active"))
    return _with_error(rows, [(bad, "ACTIVE is neither true nor false")]).withColumn("active", value)
