"""Incremental indexing of a folder of document files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cleaning import clean_page
from ..operators import chunk, store


def document_stream(spark: SparkSession, path: str, schema: str, watermark: str | None = None) -> DataFrame:
    """New rows of a folder of Parquet files; with a watermark (on ``modified``) repeated pages within it are dropped."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows if watermark is None else rows.withWatermark("modified", watermark).dropDuplicatesWithinWatermark(["document_id", "page_index"])


def index_stream(rows: DataFrame, table: store.Table, checkpoint: str, strategy: str = "sentence") -> StreamingQuery:
    """Clean, chunk and upsert each micro-batch; replaying a batch changes nothing."""
    def write(batch: DataFrame, _: int) -> None:
        documents = batch.select(F.col("document_id").alias("source_id"), F.col("page_index").alias("ordinal"), clean_page(F.col("content")).alias("content"), F.create_map(F.lit("title"), F.col("title")).alias("metadata"))
        fresh = chunk.assemble(chunk.chunk_documents(documents, strategy), documents).select("id", "document_id", "page_number", "chunk_index", "content")
        current = table.read()
        table.write(fresh if current is None else store.upsert(current, fresh))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
