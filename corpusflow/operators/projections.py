"""Fixed column lists of the index and the snapshot, and columns derived for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the index and of a snapshot, with their types.
INDEX_COLUMNS = {
    "id": "string", "document_id": "string", "title": "string", "summary": "string", "content": "string", "heading": "string", "page_number": "int", "chunk_index": "int", "language": "string", "version": "string",
    "document_type": "string", "relative_path": "string", "last_modified": "timestamp", "content_hash": "string", "table_count": "int", "has_table": "boolean", "page_quality": "double", "figure_captions": "array<string>",
    "register_document_id": "string", "vector": "array<float>",
}
SNAPSHOT_COLUMNS = ["id", "document_id", "title", "last_modified", "content", "heading", "page_number", "chunk_index", "content_hash"]
#: Search behaviour of the text columns: fields searched and returned.
SEARCHED, RETURNED = ["title", "summary", "content", "heading", "document_type"], ["id", "document_id", "title", "summary", "content", "page_number", "chunk_index"]


def _typed(rows: DataFrame, name: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(INDEX_COLUMNS[name]).alias(name)


def index_rows(chunks: DataFrame) -> DataFrame:
    """Exactly the columns of the index; those that a source lacks are typed nulls."""
    return chunks.select(*(_typed(chunks, c) for c in INDEX_COLUMNS))


def snapshot_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(*(_typed(chunks, c) for c in SNAPSHOT_COLUMNS))


def from_snapshot(snapshot: DataFrame) -> DataFrame:
    """A snapshot (with vectors) as index rows; what a snapshot does not hold is null."""
    return index_rows(snapshot)


def with_structure(chunks: DataFrame, items: str = "items", confidence: str = "confidence") -> DataFrame:
    """Table count, table flag, page quality and captions from a page's items."""
    tables = F.size(F.filter(items, lambda x: x["kind"] == "table"))
    captions = F.transform(F.filter(items, lambda x: (x["kind"] == "figure") & x["content"].isNotNull()), lambda x: x["content"])
    return chunks.withColumns({"table_count": F.coalesce(tables, F.lit(0)), "has_table": F.coalesce(tables > 0, F.lit(False)), "page_quality": F.col(confidence), "figure_captions": captions})


def lifecycle(metadata: Column) -> Column:
    """Four nullable texts of an external register from a file's metadata map."""
    return F.struct(*(F.element_at(metadata, k).alias(k) for k in ("register_document_id", "register_version", "register_status", "relative_path")))


def traceability_gap(rows: DataFrame) -> Column:
    return F.col("register_document_id").isNull() & F.col("relative_path").isNull()


def traceability_counts(files: DataFrame) -> DataFrame:
    """Distinct good files that no register entry leads to, and those without a version."""
    return files.where("ok").agg(F.count_distinct(F.when(traceability_gap(files), F.col("blob"))).alias("n_gaps"), F.count_distinct(F.when(F.col("register_version").isNull(), F.col("blob"))).alias("n_unversioned"))


def native_warnings(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Issues of ``files(blob, title, author, producer, created, n_bookmarks)`` that a file's own metadata tell."""
    now = F.current_timestamp() if now is None else now
    checks = [
        (F.col("title").isNull(), "no title"), (F.col("author").isNull(), "no author"), (F.col("producer").isNull(), "no producer"),
        (F.col("created").isNull(), "no date"), (F.col("created") > now, "date in the future"), (F.col("n_bookmarks") == 0, "no bookmarks"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks)))
    return files.select(F.col("blob").alias("document_id"), F.explode(found).alias("message"), F.lit("metadata").alias("reason"))


def analysis_warnings(parsed: DataFrame) -> DataFrame:
    """``[Code] Message`` of each warning of an analysis (column ``a``)."""
    rows = parsed.select("blob", F.explode("a.warnings").alias("w"))
    return rows.select(F.col("blob").alias("document_id"), F.concat(F.lit("["), "w.code", F.lit("] "), "w.message").alias("message"), F.lit("analysis").alias("reason"))
