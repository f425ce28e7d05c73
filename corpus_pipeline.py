"""A training corpus from ``documents``: quality rules, near-dedup, substring dedup, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes each stage to the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import has_table, materialize, numbered, table
from corpusflow.llm.minhash import near_duplicates
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.quality import judge
from corpusflow.llm.secrets import redact
from corpusflow.llm.substrings import cut_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` says how long the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or lie beyond their group's robust distance go; each row is judged by itself.

    Where the folder has ``labels``, the cutoff keeps what they call good.
    """
    labels = table(spark, sf_dir, "labels") if has_table(spark, sf_dir, "labels") else None
    return judge(docs, labels=labels).where("_q_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 one row stays: that of the smallest ``doc_id``.

    Every row is a document of its own: rows that repeat a ``doc_id``, or have
    none, are compared by their texts like all others (ids first, in order, then
    the rows without).  Documents without words stay.
    """
    rows = numbered(docs, "doc_id", "_row")
    kept = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), size=5, percent=80).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 100-byte strings go from the texts; a character that a cut splits goes too.

    Every row is a document of its own and comes back, in whatever order rows
    repeat a ``doc_id`` or have none (these come last).  A null text becomes empty.
    """
    rows = numbered(docs, "doc_id", "_row")
    cut = cut_repeats(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("kept_text").alias("text"))
    return _counted(rows.drop("text").join(cut, "_row").select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by its kind in brackets; every row comes back, null texts as they are."""
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; null texts are the end id alone."""
    return pack_documents(docs.select("doc_id", "text")).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
