"""Retrieval: lexical and vector ranking, fusion, neighbours, context, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blank

#: BM25 parameters, fusion constant, characters of context.
K1, B, RRF_K, CONTEXT_CHARS = 1.2, 0.75, 60, 16_000
NEIGHBOUR_FACTOR = 4


def words_of(column: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(column), r"(?U)[^\w]+", " "), " "), lambda w: w != "")


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, terms: list[str], key: str, text: str, k: int) -> DataFrame:
    """``(key, score, rank)`` of the best ``k``; a text is cut into words once, as a lambda's variable, and only the query's words are counted."""
    fields = lambda w: F.struct(F.size(w).alias("dl"), *(_times(w, t).alias(f"f{i}") for i, t in enumerate(terms)))
    counted = docs.select(key, F.explode(F.transform(F.array(words_of(text)), fields)).alias("c")).select(key, "c.*")
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    rows = counted.join(F.broadcast(whole))  # one row
    score = sum(
        F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        for i in range(len(terms))
    )
    return ranked(rows.select(key, score.alias("score")).where("score > 0"), key, k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` rows by score (to nine places), ties by key."""
    best = scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def vector_search(vectors: DataFrame, query: list[float], key: str, vector: str, k: int) -> DataFrame:
    """``(key, score, rank)`` of the ``k`` largest cosines; each task returns its own best ``k``."""
    q = np.asarray(query, np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, len(q))
            norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(q)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.divide(rows @ q, norms, out=np.zeros(len(rows)), where=norms > 0))], names=[key, "score"])

    fit = vectors.where(F.size(vector) == len(q)).select(key, F.col(vector).cast("array<double>"))
    return ranked(fit.mapInArrow(score, f"{key} {dict(vectors.dtypes)[key]}, score double"), key, k)


def fuse(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion."""
    every = lists[0].select(key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "rank"))
    return ranked(every.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")), key, k)


def rerank(hits: DataFrame, question: str, scorer: Callable[[str, list[str]], list[float]], key: str, text: str, k: int) -> DataFrame:
    """``(key, score, rank)`` of the best ``k`` of the hits by a model's score of question and text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(question, batch.column(1).to_pylist()), pa.float64())], names=[key, "score"])

    return ranked(hits.select(key, text).mapInArrow(score, f"{key} {dict(hits.dtypes)[key]}, score double"), key, k)


#: Fields of a reference's data, with their types.
REFERENCE = {
    "id": "string", "document_id": "string", "page_number": "int", "chunk_index": "int", "title": "string", "summary": "string", "content": "string", "quick_code": "string", "relative_path": "string",
    "register_document_id": "string", "register_version": "string", "register_status": "string", "register_url": "string", "page_count": "int", "created_at": "timestamp", "mod_date": "timestamp",
}


def map_references(references: DataFrame, column: str = "source_data") -> DataFrame:
    """Hits from references' JSON; one without content is none.

    Ids that are missing are empty and places zero; other fields that are
    missing, or not of their type, are null.
    """
    data = F.from_json(column, ", ".join(f"{c} {'string' if t == 'timestamp' else t}" for c, t in REFERENCE.items()))
    defaults = {"id": "", "document_id": "", "page_number": 0, "chunk_index": 0}
    others = [c for c in references.columns if c != column and c not in REFERENCE]
    fields = [F.coalesce(F.col("_d")[c], F.lit(defaults[c])).alias(c) if c in defaults else F.col("_d")[c].try_cast(t).alias(c) for c, t in REFERENCE.items()]
    return references.withColumn("_d", data).where(~blank(F.col("_d.content"))).select(*others, *fields)


def context_text(title: Column, summary: Column, content: Column) -> Column:
    """The content under its title, and summary if there is one, in brackets; without a title the content alone."""
    head = F.when(blank(summary), title).otherwise(F.concat(title, F.lit("\n"), summary))
    return F.when(title.isNull(), content).otherwise(F.concat(F.lit("["), head, F.lit("]\n"), content))


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the pages beside the hits' pages that no hit is on: an equi-join on exploded page numbers.

    ``hits`` and ``chunks`` have ``document_id`` and ``page_number``; a document
    gives at most four chunks for each page wanted, in order.
    """
    pages = hits.select("document_id", "page_number").distinct()
    wanted = pages.select("document_id", F.explode(F.array(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number")).where("page_number >= 0").distinct()
    wanted = wanted.join(pages, ["document_id", "page_number"], "left_anti")
    asked = wanted.groupBy("document_id").agg((F.count(F.lit(1)) * NEIGHBOUR_FACTOR).alias("most"))
    found = chunks.join(wanted, ["document_id", "page_number"]).join(asked, "document_id")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "id"))
    return found.withColumn("_r", rank).where("_r <= most").drop("_r", "most")


def context(hits: DataFrame, beside: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """Hits (with ``rank``) and neighbours in reading order, until the first that would exceed ``most`` characters.

    Documents are in order of their best hit; a hit wins over a neighbour with its id; blank contents are left out.
    What counts is ``text``: the content, under title and summary where the hits have them.
    """
    both = hits.unionByName(beside.join(hits.select("id"), "id", "left_anti").select(*(c for c in hits.columns if c != "rank")).withColumn("rank", F.lit(None).cast("int")))
    text = context_text(F.col("title"), F.col("summary"), F.col("content")) if {"title", "summary"} <= set(hits.columns) else F.col("content")
    placed = both.where(~blank(F.col("content"))).withColumn("text", text).withColumn("doc_rank", F.coalesce(F.min("rank").over(Window.partitionBy("document_id")), F.lit(2**31 - 1)))
    order = Window.orderBy("doc_rank", "document_id", "page_number", "chunk_index", "id")  # the few rows of one question
    running = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumns({"running": running, "place": F.row_number().over(order)}).where(F.col("running") <= most)


def citations(hits: DataFrame) -> DataFrame:
    """The best hit of each document, in order of rank."""
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("rank"))
    return hits.withColumn("_r", first).where("_r = 1").drop("_r")


def token_totals(activity: DataFrame) -> DataFrame:
    told = activity.where(F.col("type").isin("planning", "synthesis"))
    return told.agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
