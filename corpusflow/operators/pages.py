"""Joining, classifying, deduplicating and cleaning paged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning, scalar


def first_by(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def index_lookup(index: DataFrame, order: str = "row_no") -> DataFrame:
    """One row for each id (case-insensitive), the first; ``duplicates`` says how many others there were."""
    key = F.upper("document_id")
    by = Window.partitionBy("_key")
    rows = index.withColumn("_key", key).withColumn("duplicates", F.count(F.lit(1)).over(by) - 1)
    return first_by(rows, ["_key"], [order])


def join_pages(pages: DataFrame, index: DataFrame, order: str = "row_no") -> DataFrame:
    """Every page with its index row and a ``status``: joined, inactive or missing.

    ``reported`` marks the first page of each document that is not joined: its
    error or warning is told once.  One left join, then a classification.
    """
    lookup = index_lookup(index, order)
    taken = [F.col(c).alias(c if c not in pages.columns else f"index_{c}") for c in lookup.columns if c not in ("document_id", "_key")]
    joined = pages.withColumn("_key", F.upper("document_id")).join(lookup.select("_key", F.lit(True).alias("_known"), *taken), "_key", "left")
    status = F.when(F.col("_known").isNull(), "missing").when(~F.col("active"), "inactive").otherwise("joined")
    first = F.row_number().over(Window.partitionBy("_key").orderBy("page_index", order)) == 1
    joined = joined.withColumn("status", status)
    return joined.withColumn("reported", (F.col("status") != "joined") & first).drop("_key", "_known")


def index_without_pages(pages: DataFrame, index: DataFrame, order: str = "row_no") -> DataFrame:
    keys = pages.select(F.upper("document_id").alias("_key")).distinct()
    return index_lookup(index, order).join(keys, "_key", "left_anti").drop("_key")


def dedupe(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows with ``duplicate``: false for the first of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("duplicate", rank > 1)


def clean_joined(pages: DataFrame, order: str = "row_no") -> DataFrame:
    """Joined pages, typed and cleaned, with ``outcome`` (record, duplicate or error) and ``reason``.

    One pass tells records, errors and warnings apart; a blank page stays a
    record with the warning ``blank``.
    """
    rows = dedupe(pages, ["document_id", "page_index"], [order])
    modified = scalar.exact_timestamp(scalar.trimmed(F.col("last_modified_datetime")))
    checked, bad_check = scalar.optional_date(F.col("check_date"))
    flags, bad_flags = scalar.string_array(F.col("attention_required_flags"))
    content = cleaning.clean_page(F.col("page_content"))
    rows = rows.select(
        *(scalar.trimmed(F.col(c)).alias(c) for c in ("document_id", "title", "quick_code", "folder_mini_full_path", "relative_path", "language", "document_type_name", "summary")),
        "page_index",
        "duplicate",
        scalar.version_text(F.col("version"), F.col("revision")).alias("version"),
        modified.alias("last_modified"),
        checked.alias("check_date"),
        flags.alias("flags"),
        content.alias("content"),
        bad_check.alias("_bad_check"),
        bad_flags.alias("_bad_flags"),
        cleaning.has_mojibake(F.col("page_content")).alias("mojibake_fixed"),
    )
    reason = F.when(F.col("last_modified").isNull(), "modified").when(F.col("_bad_check"), "check_date").when(F.col("_bad_flags"), "flags")
    outcome = F.when(F.col("duplicate"), "duplicate").when(reason.isNotNull(), "error").otherwise("record")
    warning = F.when((outcome == "record") & scalar.blank(F.col("content")), "blank")
    return rows.withColumns({"reason": reason, "outcome": outcome, "warning": warning}).drop("_bad_check", "_bad_flags", "duplicate")


def to_documents(cleaned: DataFrame) -> DataFrame:
    """``(source_id, ordinal, content, metadata)``: the form that chunkers of any source read."""
    day = F.date_format("last_modified", "yyyy-MM-dd")
    metadata = F.create_map(
        *(x for c in ("title", "quick_code", "folder_mini_full_path", "relative_path", "language", "document_type_name", "summary", "version") for x in (F.lit(c), F.col(c))),
        F.lit("last_modified"), day, F.lit("last_modified_at"), F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    )
    return cleaned.where("outcome = 'record'").select(F.col("document_id").alias("source_id"), F.col("page_index").alias("ordinal"), "content", metadata.alias("metadata"))
