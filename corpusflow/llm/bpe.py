"""Byte-level BPE over a corpus: each distinct word is encoded once for all documents.

1. A task cuts its texts into pre-tokens and keeps, for a block of texts, the
   distinct words and the positions as numbers of words (a block's own codes,
   the frequent ones small).
2. Words are dealt by hash, all words of a block that go to one partition in
   one row; the partition encodes each distinct word once, whatever number of
   blocks sent it, and sends ids back to the blocks.  A word that makes a third
   of all text is one entry of a block.
3. Blocks lie in a bucketed table, so the ids come to them and they are not
   shuffled.  A block puts its documents' ids together by position and decodes them with
   the token-byte table (bounded: one row for each token of the vocabulary).
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, text_slices
from .tokens import BPE_RANKS, distinct_words, ragged, rank_encoder, read_ranks

BLOCK_BYTES = 16 << 20
_ROWS = "target long, block long, kind int, payload binary"


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each in its smallest type, compressed; wider ones by byte planes."""
    parts = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max(initial=0)))
        a = np.ascontiguousarray(a.astype(kind))
        parts.append(struct.pack("<Bq", kind.itemsize, a.size))
        parts.append(a.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def thaw(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        width, size = struct.unpack_from("<Bq", data, at)
        at += 9
        planes = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64) if width < 8 else np.ascontiguousarray(planes.T).view("<u8").ravel().view(np.int64))
        at += width * size
    return out


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["target", "block", "kind", "payload"])


class _Block:
    """Distinct words and positions of some texts, gathered slice by slice."""

    def __init__(self):
        self.docs: list = []
        self.known: dict[int, int] = {}
        self.counts: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[str] = []
        self.bytes = 0

    def add(self, docs: list, texts: list[str], size: int) -> None:
        bounds, index, hashes, (points, starts, ends) = distinct_words(texts)
        before, known = len(self.known), self.known
        codes = np.fromiter((known.setdefault(h, len(known)) for h in hashes.tolist()), np.int64, len(hashes))
        fresh = np.flatnonzero(codes >= before)
        sizes = ends[fresh] - starts[fresh]
        self.words.append(ragged(points, starts[fresh], sizes, np.arange(len(fresh))).tobytes().decode("utf-32-le", "surrogatepass"))
        self.sizes.append(sizes)
        self.docs += docs
        self.counts.append(np.diff(bounds))
        self.index.append(codes[index].astype(np.uint32))
        self.bytes += size

    def rows(self, number: int, targets: int) -> Iterator[pa.RecordBatch]:
        index = np.concatenate(self.index)
        sizes = np.concatenate(self.sizes)
        hashes = np.fromiter(self.known, np.uint64, len(self.known))
        code_of = np.empty(len(hashes), np.uint32)  # frequent words get small codes
        code_of[np.argsort(-np.bincount(index, minlength=len(hashes)), kind="stable")] = np.arange(len(hashes))
        ids = np.array([0 if d is None else d for d in self.docs], np.int64).view(np.uint64)
        known = np.array([d is not None for d in self.docs], np.uint8)
        yield _row_batch([(number, number, 0, freeze(ids, known, np.concatenate(self.counts), code_of[index]))])
        points = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        target = (hashes % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(order) else []:
            text = ragged(points, starts, sizes, own).tobytes().decode("utf-32-le", "surrogatepass")
            rows.append((int(target[own[0]]), number, 1, freeze(code_of[own], sizes[own], np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))))
        if rows:
            yield _row_batch(rows)


def _block_rows(targets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for part in text_slices(batch):
                held.add(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], part.column(1).nbytes)
                if held.bytes >= BLOCK_BYTES:
                    yield from held.rows(number, targets)
                    number, held = number + 1, _Block()
        if held.docs:
            yield from held.rows(number, targets)

    return rows


def _word_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path)._encode_single_piece  # a word is one match of the pattern already
        known: dict[str, list[int]] = {}
        for batch in batches:
            for _, number, _, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, sizes, data = thaw(payload)
                text = data.astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")
                found, at = [], 0
                for size in sizes.tolist():
                    word = text[at : at + size]
                    at += size
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encode(word)
                    found.append(own)
                counts = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum()))
                yield _row_batch([(number, number, 1, freeze(codes, counts, ids))])

    return rows


def _tables(path: str) -> tuple[np.ndarray, ...]:
    """For each id its bytes and its decimal digits with a comma: flat, begins, sizes."""
    ranks = read_ranks(path)
    out: list[np.ndarray] = []
    token = [b""] * (max(ranks.values()) + 1)
    for data, k in ranks.items():
        token[k] = data
    for table in (token, [b"%d," % k for k in range(len(token))]):
        sizes = np.array([len(t) for t in table])
        out += [np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes]
    return tuple(out)


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary"


def _document_rows(path: str, whole: bool):
    def documents(frozen: bytes, parts: list[bytes], tables: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        docs, known, lengths, index = thaw(frozen)
        words = [thaw(p) for p in parts]
        codes, counts, ids = (np.concatenate([w[k] for w in words]) if words else np.zeros(0, np.int64) for k in range(3))
        starts = np.cumsum(counts) - counts
        begin, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        begin[codes], size[codes] = starts, counts
        out, at = [], 0
        for doc, valid, n in zip(docs.tolist(), known.tolist(), lengths.tolist(), strict=True):
            own = ragged(ids, begin, size, index[at : at + n])
            at += n
            digits = ragged(*tables[3:], own).tobytes()[:-1]
            decoded = ragged(*tables[:3], own).tobytes()
            out.append((doc if valid else None, len(own), hashlib.sha256(digits).hexdigest(), hashlib.sha256(decoded).hexdigest(), own if whole else None, decoded if whole else None))
            if len(out) == 500:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(path)
        for batch in batches:
            for k in range(batch.num_rows):
                yield from documents(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or [], tables)

    return rows


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` written to the shared folder in buckets by ``block``: a join by block then leaves them where they are."""
    spark = rows.sparkSession
    name = f"corpusflow_blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "none").option("path", f"{shared_dir(spark)}/corpusflow/{name}").bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def encode_documents(docs: DataFrame, ranks: str = BPE_RANKS, whole: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded)`` for every row of ``docs(doc_id, text)``.

    The ids are those of the ranks over each match of the tokenizer pattern
    separately, without special tokens; ``ids`` and ``decoded`` are null unless
    ``whole``.  Texts are cut by :func:`tokens.pretoken_starts`, so runs of any length
    (white space included) encode.  Hashes are of the decimal ids joined by commas and of the bytes
    that the ids decode to.  Null and empty texts have no tokens.  Repeated and
    null ``doc_id`` are no special case.  Other columns are ignored; an empty
    table gives no rows.

    The blocks are an external table ``corpusflow_blocks_*`` over the shared
    folder, which may be dropped once the result has been read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    blocks = _bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_block_rows(parts), _ROWS), parts)
    ids = blocks.where("kind = 1").repartition(parts, "target").mapInArrow(_word_rows(ranks), _ROWS)
    ids = ids.groupBy("block").agg(F.collect_list("payload").alias("ids"))  # a block's own words: bounded by the block
    texts = blocks.where("kind = 0").select("block", "payload")
    return texts.join(ids, "block", "left").select("payload", "ids").mapInArrow(_document_rows(ranks, whole), _RESULT)
