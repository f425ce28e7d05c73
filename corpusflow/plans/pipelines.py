"""Whole runs: index an export, restore an index, ask a question."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, scalar
from ..operators import chunk, diff, embed, pages, projections, quality, report, retrieve, store, structure, validate
from ..sources import csv_export


class GateError(RuntimeError):
    """The run's data are not good enough to index; ``report`` says why."""

    def __init__(self, told: dict):
        super().__init__(f"error rate {told['error_rate']:.2f} %, problems: {told['problems']}, magnitude: {told['magnitude']}")
        self.report = told


@dataclass
class IndexTables:
    """The tables of one index under a folder, and the reports of its runs beside them."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.chunks, self.cache, self.snapshots = (store.Table(self.spark, f"{self.root}/{n}") for n in ("chunks", "cache", "snapshots"))
        self.statistics = store.Table(self.spark, f"{self.root}/statistics")


def _judge(issues: DataFrame, verdict: DataFrame, records: DataFrame, key: str, tables: IndexTables, run_id: str, environment: str) -> dict:
    """Keep a run's issues, and a few of its records to look at; its verdict is returned."""
    report.archive(issues, f"{tables.root}/archive", run_id, "extraction")
    report.archive(quality.spot_check(records, key), f"{tables.root}/archive", run_id, "sample")
    run = verdict.first().asDict()
    report.write_report(verdict, f"{tables.root}/reports/{run_id}", environment)
    return {"run_id": run_id, **run}


def _embed(chunks: DataFrame, tables: IndexTables, embedder: embed.Embedder, dims: int, run_id: str) -> tuple[DataFrame, DataFrame, store.Table]:
    """Chunks with vectors, the cache with what is new, and the table that hands new vectors on; the caller drops it."""
    cache = tables.cache.read()
    cache = cache if cache is not None else tables.spark.createDataFrame([], "content_hash string, vector array<float>")
    handed = store.Table(tables.spark, f"{tables.root}/handed/{run_id}")

    def keep(rows: DataFrame) -> DataFrame:
        handed.write(rows)
        return handed.read()

    embedded, fresh = embed.embed_missing(chunks, cache, embedder, dims, keep)
    report.archive(chunk.chunk_statistics(chunks), f"{tables.root}/archive", run_id, "chunking")
    report.archive(embed.run_totals(embedded, fresh), f"{tables.root}/archive", run_id, "embedding")
    return embedded, cache.unionByName(embed.cache_rows(fresh)).dropDuplicates(["content_hash"]), handed


def _store(merged: DataFrame, cache: DataFrame, tables: IndexTables, snapshot: Callable[[DataFrame], DataFrame], source: str, run: dict) -> None:
    """Write the index, evict from the cache, take a snapshot, drop old versions, look for drift."""
    seen = Observation(f"index-{run['run_id']}")
    tables.chunks.write(report.observed(merged, seen, n_chunks=F.count(F.lit(1)), n_vectors=F.count_if(F.col("vector").isNotNull())))
    run |= {"index_chunks": seen.get["n_chunks"], "index_vectors": seen.get["n_vectors"]}
    written = tables.chunks.read()
    tables.cache.write(store.evict(cache, written))
    tables.snapshots.write(snapshot(written))
    for table in (tables.chunks, tables.cache, tables.snapshots):
        table.prune()
    try:
        run["red_flags"] = run["red_flags"] + validate.record_statistics(tables.statistics, source, run["records"], *tables.chunks.statistics())
    except Exception as error:  # the index is written: statistics that fail do not undo the run
        run["red_flags"] = [*run["red_flags"], f"no statistics: {error}"]


def index_export(
    spark: SparkSession, pages_path: str, index_path: str, tables: IndexTables, embedder: embed.Embedder, dims: int, force: bool = False, strategy: str = "sentence", previous_pages: int | None = None, override: bool = False,
    environment: str = "Production", run_id: str | None = None,
) -> dict:
    """Read, join, clean, gate, diff, chunk, embed what changed, write, drop orphans. The report of the run is returned.

    The number of records is held against ``previous_pages``, or else against
    the last run's.  Issues, a sample and counts of each stage go to the archive.
    """
    run_id = run_id or uuid.uuid4().hex
    parsed = csv_export.read_pages(spark, pages_path).persist()
    index = csv_export.read_index(spark, index_path).persist()
    joined = pages.join_pages(parsed.where("error is null"), index.where("error is null").drop("error")).persist()
    cleaned = pages.clean_joined(joined.where("status = 'joined'")).persist()
    issues = validate.export_issues(parsed, index, joined, cleaned).persist()
    before = validate.last_statistics(tables.statistics, "export")
    previous = previous_pages if previous_pages is not None else before and before["records"]
    records = cleaned.where("outcome = 'record'")
    run = _judge(issues, validate.export_report(issues, parsed, index, joined, cleaned, previous, override), records, "document_id", tables, run_id, environment)
    if not run["passed"]:
        raise GateError(run)

    current = tables.chunks.read()
    source = records.groupBy("document_id").agg(F.max("last_modified").alias("modified"))
    known = diff.indexed_dates(current) if current is not None else spark.createDataFrame([], "key string, indexed timestamp")
    changes = diff.classify(source, known, force=force).persist()
    run |= {f"docs_{r['status']}": r["n_docs"] for r in diff.counts(changes).collect()}
    documents = pages.to_documents(records.join(changes.where("status in ('new', 'updated')").select("key"), F.upper("document_id") == F.col("key"), "left_semi"))
    chunks = chunk.assemble(chunk.chunk_documents(documents, strategy), documents)
    embedded, cache, handed = _embed(chunks, tables, embedder, dims, run_id)
    metadata = F.col("metadata")
    fields = {"title": "title", "summary": "summary", "language": "language", "version": "version", "document_type": "document_type_name", "relative_path": "relative_path"}
    embedded = embedded.withColumns({c: metadata[k] for c, k in fields.items()} | {"last_modified": F.to_timestamp(metadata["last_modified_at"])})
    embedded = projections.index_rows(embedded).persist()
    run["chunks_written"] = embedded.count()
    merged = embedded
    if current is not None:
        gone = store.orphans(current, changes.where("stale"), embedded)
        merged = store.upsert(store.delete(current, gone), embedded)
    _store(merged, cache, tables, lambda rows: rows.drop("vector"), "export", run)
    for frame in (parsed, index, joined, cleaned, issues, changes, embedded):
        frame.unpersist()
    handed.drop()
    return run


def index_files(
    spark: SparkSession, listing: DataFrame, layouts: DataFrame, tables: IndexTables, embedder: embed.Embedder, dims: int, force: bool = False, outlines: DataFrame | None = None, native: DataFrame | None = None,
    environment: str = "Production", run_id: str | None = None,
) -> dict:
    """Index analysed files: diff the listing first, so that unchanged files are never read or cleaned.

    ``listing(blob, modified[, active])`` names all files; ``layouts(blob, layout)``
    is read for new and updated ones only.  ``outlines(doc, ord, title, level,
    page, external)`` gives headings, ``native`` the files' own metadata.  A file
    that fails keeps its old chunks.  A run that read files and does not pass
    stops, but for development.
    """
    run_id = run_id or uuid.uuid4().hex
    current = tables.chunks.read()
    known = diff.indexed_dates(current) if current is not None else spark.createDataFrame([], "key string, indexed timestamp")
    changes = diff.classify(listing.withColumnRenamed("blob", "document_id"), known, force=force).persist()
    statuses = {f"docs_{r['status']}": r["n_docs"] for r in diff.counts(changes).collect()}
    wanted = changes.where("status in ('new', 'updated')").select("key")
    parsed = structure.read_layout(layouts.join(wanted, F.upper("blob") == F.col("key"), "left_semi")).persist()
    found = structure.layout_pages(parsed)
    context = structure.page_context(structure.layout_items(parsed))
    body = cleaning.clean_extracted(cleaning.drop_decoration(F.col("content")))
    rows = found.withColumn("content", body).join(context.select("blob", "page", "items", "table_count"), ["blob", "page"], "left").withColumn("table_count", F.coalesce("table_count", F.lit(0))).persist()
    issues = validate.files_issues(parsed, rows, native).persist()
    before = validate.last_statistics(tables.statistics, "files")
    run = _judge(issues, validate.files_report(issues, parsed, rows, before and before["records"]), rows.select("blob", "page", "content"), "blob", tables, run_id, environment) | statuses
    if not run["passed"] and run["attempted"] and environment != "Development":
        raise GateError(run)
    if outlines is not None:
        paths = structure.page_sections(rows.select(F.col("blob").alias("doc"), "page"), structure.breadcrumb_paths(outlines))
        placed = rows.join(paths.select(F.col("doc").alias("blob"), "page", "path"), ["blob", "page"], "left")
    else:
        placed = rows.withColumn("path", F.lit(None).cast("string"))
    first = F.get(F.filter("items", lambda x: x["kind"] == "heading"), F.lit(0))["content"]
    placed = placed.withColumn("heading", F.coalesce(F.concat(F.lit("_Section: "), "path", F.lit("_")), first))
    title = scalar.title_or_stem(F.lit(None).cast("string"), F.col("blob"))
    documents = placed.select(F.col("blob").alias("source_id"), F.col("page").alias("ordinal"), "content", F.create_map(F.lit("title"), title, F.lit("heading"), F.col("heading")).alias("metadata"), "items", "confidence")
    chunks = chunk.assemble(chunk.chunk_documents(documents, "paragraph"), documents)
    extra = projections.with_structure(documents).select(F.col("source_id").alias("document_id"), F.col("ordinal").alias("page_number"), "table_count", "has_table", "page_quality", "figure_captions")
    chunks = chunks.join(extra, ["document_id", "page_number"]).join(listing.select(F.col("blob").alias("document_id"), F.col("modified").alias("last_modified")), "document_id")
    embedded, cache, handed = _embed(chunks, tables, embedder, dims, run_id)
    embedded = projections.index_rows(embedded.withColumn("title", F.col("metadata")["title"])).persist()
    run["chunks_written"] = embedded.count()
    failed = parsed.where("not ok").select(F.upper("blob").alias("key"))
    merged = embedded
    if current is not None:
        gone = store.orphans(current, changes.where("stale").join(failed, "key", "left_anti"), embedded)
        merged = store.upsert(store.delete(current, gone), embedded)
    if not run["attempted"]:
        run["records"] = (before or run)["records"]  # a run that read nothing does not change what the next is held against
    _store(merged, cache, tables, projections.snapshot_rows, "files", run)
    for frame in (changes, parsed, rows, issues, embedded):
        frame.unpersist()
    handed.drop()
    return run


def restore_index(tables: IndexTables) -> int:
    """Rebuild the index from the newest snapshot and the vector cache; the number of missing vectors is returned."""
    snapshot, cache = tables.snapshots.read(), tables.cache.read()
    if snapshot is None:
        raise ValueError("no snapshot to restore from")
    cache = cache if cache is not None else tables.spark.createDataFrame([], "content_hash string, vector array<float>")
    rows = store.restore(snapshot, cache)
    tables.chunks.write(projections.from_snapshot(rows))
    return rows.where("missing").count()


def extract_answer(question: str, texts: list[str]) -> str:
    """The stand-in for a language model: the best context as it is."""
    return texts[0] if texts else ""


def ask(chunks: DataFrame, question: str, embedder: embed.Embedder, k: int = 10, synthesizer: Callable[[str, list[str]], str] = extract_answer, reranker: Callable[[str, list[str]], list[float]] | None = None) -> dict:
    """Answer, context and citations of a question over an index's chunks; a ``reranker`` orders the fused hits by its scores."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    terms = sorted(set("".join(c if c.isalnum() else " " for c in question.lower()).split()))
    lexical = retrieve.bm25(chunks, terms, "id", "content", 5 * k)
    near = retrieve.vector_search(chunks.where("vector is not null"), embedder([question])[0], "id", "vector", 5 * k)
    best = retrieve.fuse([lexical, near], "id", 5 * k if reranker else k)
    if reranker:
        best = retrieve.rerank(chunks.join(best.select("id"), "id", "left_semi"), question, reranker, "id", "content", k)
    columns = [c for c in projections.RETURNED if c in chunks.columns]
    hits = chunks.join(best.select("id", "rank"), "id").select(*columns, "rank").persist()
    told = retrieve.context(hits, retrieve.neighbours(hits, chunks).select(*columns)).orderBy("place").collect()
    cited = retrieve.citations(hits).orderBy("rank").collect()
    hits.unpersist()
    texts = [r["text"] for r in told]
    return {"answer": synthesizer(question, texts), "context": "\n\n---\n\n".join(texts), "citations": [{"document_id": r["document_id"], "page": r["page_number"]} for r in cited]}
