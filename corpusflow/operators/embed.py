"""Embedding of chunks, with a cache by content hash."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import content_hash, truncated

Embedder = Callable[[list[str]], list[list[float]]]
#: Texts of a request, tries of one, and seconds between them.
REQUEST, TRIES, WAITS = 100, 5, (2, 4, 8, 16)


def hashing_embedder(dims: int = 64) -> Embedder:
    """Deterministic unit vectors from hashed words, for runs without a model."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % dims] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return embed


def with_hash(chunks: DataFrame, text: str = "content") -> DataFrame:
    short, cut = truncated(F.col(text))
    return chunks.withColumns({"embedding_text": short, "was_truncated": cut, "content_hash": content_hash(F.col(text))})


def split_by_cache(chunks: DataFrame, cache: DataFrame, dims: int | None) -> DataFrame:
    """``chunks`` with the cached ``vector`` (null: to be embedded); with ``dims`` only vectors of that size count."""
    known = cache.where(F.size("vector") == dims) if dims else cache
    return chunks.join(known.select("content_hash", "vector").dropDuplicates(["content_hash"]), "content_hash", "left")


def transient(error: Exception) -> bool:
    """Whether another try may help: no answer, too many requests, or a failure on the other side."""
    status = getattr(error, "status", getattr(error, "code", None))
    return isinstance(error, (TimeoutError, ConnectionError)) or status == 429 or (isinstance(status, int) and 500 <= status < 600)


def embed_texts(rows: DataFrame, embedder: Embedder, dims: int, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``(content_hash, vector, retries, bad_dims)`` for ``rows(content_hash, embedding_text)``, a request for each hundred texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REQUEST):
                part = batch.slice(at, REQUEST)
                for n in range(TRIES):
                    try:
                        vectors = embedder(part.column(1).to_pylist())
                        break
                    except Exception as error:
                        if n == TRIES - 1 or not transient(error):
                            raise
                        wait(WAITS[n])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([n] + [0] * (part.num_rows - 1), pa.int32()), pa.array([len(v) != dims for v in vectors])], names=["content_hash", "vector", "retries", "bad_dims"])

    return rows.select("content_hash", "embedding_text").mapInArrow(run, "content_hash string, vector array<float>, retries int, bad_dims boolean")


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder: Embedder, dims: int, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """All chunks with vectors and ``cached``, and what was embedded, as from :func:`embed_texts`; each missing text is embedded once.

    ``keep`` holds what was embedded; one that writes it and reads it back saves
    a lost executor from paying again.
    """
    split = split_by_cache(with_hash(chunks), cache, dims).withColumn("cached", F.col("vector").isNotNull())
    missing = split.where("vector is null").dropDuplicates(["content_hash"])
    fresh = keep(embed_texts(missing, embedder, dims))
    got = split.drop("vector").join(cache.where(F.size("vector") == dims).select("content_hash", "vector").unionByName(fresh.select("content_hash", "vector")).dropDuplicates(["content_hash"]), "content_hash", "left")
    return got, fresh


def cache_rows(fresh: DataFrame) -> DataFrame:
    """What the cache takes of new vectors: those of the right size."""
    return fresh.where(~F.col("bad_dims")).select("content_hash", "vector")


def run_totals(embedded: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """One row of counts; with ``fresh`` also cache hits, retries and vectors of a wrong size."""
    if fresh is not None:
        told = fresh.agg(F.coalesce(F.sum("retries"), F.lit(0)).alias("n_retries"), F.count_if("bad_dims").alias("n_bad_dims"))
        return run_totals(embedded).join(embedded.agg(F.count_if("cached").alias("n_cached"))).join(told)  # single rows
    return embedded.agg(F.count_if("was_truncated").alias("n_truncated"), F.count_if(F.col("vector").isNotNull()).alias("n_embedded"), F.count(F.lit(1)).alias("n_chunks"))
