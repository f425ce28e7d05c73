"""What changed between a source and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indexed_dates(chunks: DataFrame) -> DataFrame:
    """The latest known date of each indexed document (case-insensitive); documents without any are left out."""
    dated = chunks.where("last_modified is not null")
    return dated.groupBy(F.upper("document_id").alias("key")).agg(F.max("last_modified").alias("indexed"))


def classify(source: DataFrame, indexed: DataFrame, force: bool = False, truncate: bool = False) -> DataFrame:
    """``(key, status, stale)`` from ``source(document_id, modified[, active])`` and ``indexed(key, indexed)``.

    New: not indexed.  Skipped: not newer than the index and not forced.
    Removed: indexed but not in the source.  Inactive: not processed, and stale
    if indexed.  All others are updated, also those whose date is unknown.
    ``truncate`` compares by day, which misses changes of the same day; the
    default does not.
    """
    active = F.col("active") if "active" in source.columns else F.lit(True)
    modified = F.date_trunc("day", "modified") if truncate else F.col("modified")
    rows = source.select(F.upper("document_id").alias("key"), modified.alias("modified"), active.alias("active"))
    rows = rows.groupBy("key").agg(F.max("modified").alias("modified"), F.bool_or("active").alias("active"))
    both = rows.withColumn("_s", F.lit(True)).join(indexed.withColumn("_i", F.lit(True)), "key", "full_outer")
    fresh = F.lit(not force) & (F.col("modified") <= F.col("indexed"))
    status = (
        F.when(F.col("_s").isNull(), "removed")
        .when(~F.col("active"), "inactive")
        .when(F.col("_i").isNull(), "new")
        .when(F.coalesce(fresh, F.lit(False)), "skipped")
        .otherwise("updated")
    )
    both = both.withColumn("status", status)
    stale = F.col("status").isin("updated", "removed") | ((F.col("status") == "inactive") & F.col("_i").isNotNull())
    return both.select("key", "status", stale.alias("stale"))


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("n_docs"))
