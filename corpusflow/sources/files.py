"""Files, JSON, link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

GOLDEN = "Name string, Department string, Query string, ExpectedAnswer string, ExpectedSources array<string>, Difficulty string, Value string, AnswerableFromCorpus boolean"


def list_files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """``(blob, modified, length)`` without reading contents; the suffix matches in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(suffix)).select(F.col("path").alias("blob"), F.coalesce("modificationTime", F.lit("0001-01-01").cast("timestamp")).alias("modified"), "length")


def read_bytes(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(suffix)).select(F.col("path").alias("blob"), "content", F.sha2("content", 256).alias("file_hash"))


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame | None:
    """JSON of a schema; none if the file is missing."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException:
        if missing_ok:
            return None
        raise


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(GOLDEN).option("multiLine", "true").json(path)
    return rows.where(F.col("Query").rlike(r"(?U)\S")).withColumn("AnswerableFromCorpus", F.coalesce("AnswerableFromCorpus", F.lit(True)))


def read_links(spark: SparkSession, path: str, prefix: str = "/richtlijnen/") -> DataFrame:
    """Distinct trimmed lines with the prefix."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("link"))
    return lines.where(F.col("link").startswith(prefix)).distinct()


def links_to_fetch(links: DataFrame, existing: DataFrame) -> DataFrame:
    return links.join(existing.select("link"), "link", "left_anti")


def enough_words(text, least: int = 100):
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= least


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
