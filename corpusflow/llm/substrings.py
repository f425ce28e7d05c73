"""Removal of repeated byte strings with sharded suffix arrays.

A byte of a document goes if a string of ``length`` bytes that covers it also
starts earlier (in a smaller ``doc_id``, or earlier in the same document).

Anchors: every window of ``length`` bytes picks its first gram of ``GRAM`` bytes with
the smallest hash, so equal windows pick equal anchors at equal places.  An
anchor's piece is what the windows that picked it cover.  Grams say only which
pieces to look at: those whose gram occurs twice.  Their bytes are dealt to
shards by what they must share, and each shard is decided by its suffix array
(induced sorting) and permuted common prefixes: two windows are equal where all
common prefixes between them in the suffix array reach ``length``.  Pieces that
are equal byte for byte are one string of the array that occurs at several
places.  Nothing is removed because hashes are equal.

Skew: equal pieces of a slice of text are compared and counted together before
the shuffle, so copies and passages cost a row for each slice and anchor.  A gram
that is frequent within a slice is known to be shared, so at most one row for
each slice meets the others of its gram.  A shard key with more than ``HOT_ROWS``
pieces (a passage of which each document has other surroundings) is decided by
its windows, grouped by their bytes in DataFrame steps that combine and split.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import SLICE_BYTES, discard, flat_bytes, materialize, shuffle_partitions, text_slices
from .suffix import common_prefixes, place_type, suffix_array

GRAM = 32
#: Text bytes whose anchors a task combines before they are shuffled.
COMBINE_BYTES = 8 * SLICE_BYTES
#: Bytes of pieces in one suffix array; more only where one key has them.
SHARD_BYTES = 1 << 20
#: Pieces of one key that a suffix array takes; a key with more is decided window by window.
HOT_ROWS = 20_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``values[i : i + width]`` for each i; the last ones see a shorter run."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place in it, bytes to its left and right in its piece, gram hash and piece hash of each anchor.

    A window's anchor is the first of its grams with the smallest hash; the
    windows of one anchor are consecutive, and its piece is their bytes.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = kernels.prefix_hash(data)
    place = np.arange(n - GRAM + 1)
    grams = kernels.range_hash(sums, place, place + GRAM)
    rank = grams & np.uint64(0xFFFFFFFF00000000) | place.astype(np.uint64)
    picked = (_sliding_least(rank, length - GRAM + 1)[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(picked)), side="right") - 1
    window = np.flatnonzero(offsets[row + 1] - np.arange(len(picked)) >= length)  # those within one row
    picked, row = picked[window], row[window]
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))[: len(picked)]
    last = np.append(first[1:], len(picked)) - 1
    at, row, start, end = picked[first], row[first], window[first], window[last[: len(first)]] + length
    whole = kernels.mix(kernels.range_hash(sums, start, end) + (at - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return row, at - offsets[row], at - start, end - at, grams[at], whole


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last]


_ANCHORS = "h long, kind int, doc long, loc long"
#: Kinds of rows: a gram's first piece in a slice (and one whose gram the slice holds again), a piece to look at, covered bytes.
FIRST, FIRST_OF_MANY, LOOK, COVERED = range(4)


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return kernels.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64)


def _anchor_batch(h: np.ndarray, kind: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(loc, pa.int64())], names=["h", "kind", "doc", "loc"])


def _equal_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray, together: int = 1 << 15) -> np.ndarray:
    """Whether the ``size`` bytes from ``one`` and from ``other`` are the same."""
    out = np.zeros(len(one), bool)
    for k in range(0, len(one), together):
        a, b, n = one[k : k + together], other[k : k + together], size[k : k + together]
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        out[k : k + together] = np.logical_and.reduceat(data[np.repeat(a, n) + within] == data[np.repeat(b, n) + within], ends - n)
    return out


def _anchor_rows(length: int):
    def combined(texts: list[np.ndarray], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate(texts)
        h, ctx, doc, loc, begin = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((loc, doc, ctx, h))
        h, ctx, doc, loc, begin = h[order], ctx[order], doc[order], loc[order], begin[order]
        size = (loc >> 8 & 255) + (loc & 255)
        other_gram = np.append(True, h[1:] != h[:-1])[: len(h)]
        fresh = other_gram | np.append(True, ctx[1:] != ctx[:-1])[: len(h)]
        owner = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        later = np.flatnonzero(~fresh & (size == size[owner]))
        later = later[_equal_bytes(data, begin[later], begin[owner[later]], size[later])]
        covered = np.zeros(len(h), bool)
        covered[later] = True
        itself = covered & (doc == doc[owner]) & (loc == loc[owner])  # a repeated row
        at = (loc >> 16)[covered & ~itself]
        where = _runs(doc[covered & ~itself], at - (loc >> 8 & 255)[covered & ~itself], at + (loc & 255)[covered & ~itself])
        yield _anchor_batch(_spread(where[0], where[1]), np.full(len(where[0]), COVERED), where[0], where[1] << 32 | where[2])
        many = np.append(h[1:] == h[:-1], False)[: len(h)]
        kind = np.where(other_gram, np.where(many, FIRST_OF_MANY, FIRST), LOOK)[~covered]
        h, doc, loc = h[~covered], doc[~covered], loc[~covered]
        yield _anchor_batch(np.where(kind == LOOK, _spread(doc, loc), h), kind, doc, loc)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch.filter(batch.column(0).is_valid())):
                data, offsets = flat_bytes(part.column(1))
                row, at, left, right, gram, whole = anchors(data, offsets, length)
                doc = part.column(0).to_numpy(zero_copy_only=False)[row]
                held.append((gram.view(np.int64), whole.view(np.int64), doc, at << 16 | left << 8 | right, size + offsets[row] + at - left))
                texts.append(data)
                size += len(data)
                if size >= COMBINE_BYTES:
                    yield from combined(texts, held)
                    held, texts, size = [], [], 0
        if held:
            yield from combined(texts, held)

    return rows


_PIECES = "key long, doc long, start long, piece binary"


def _piece_rows(length: int):
    """Bytes of the pieces, each in two halves: the windows that hold the bytes before the anchor, and those after."""
    span = length - GRAM
    half = span // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keys, docs, starts, pieces = [], [], [], []
                for doc, text, locs in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    for loc in locs.values.to_pylist():
                        at = loc >> 16
                        low, high = at - (loc >> 8 & 255), at + (loc & 255)
                        sides = []
                        if at - half >= low:  # windows that reach at least ``half`` bytes before the anchor
                            sides.append((b"l" + data[at - half : at + GRAM], low, min(high, at + length - half)))
                        if at + length - half <= high:  # windows that reach at most ``half``
                            sides.append((b"r" + data[at : at + length - half], max(low, at - half), high))
                        for shared, a, b in sides:
                            if b - a >= length:
                                keys.append(int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True))
                                docs.append(doc)
                                starts.append(a)
                                pieces.append(data[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "doc", "start", "piece"])

    return rows


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of piece and offset of the windows that also start earlier, by suffix array and permuted prefixes.

    ``pieces[k]`` lies at ``start[k]`` of document ``doc[k]``; a window that two pieces hold is one window.
    """
    sizes = np.array([len(p) for p in pieces])
    symbols = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    kind = place_type(len(symbols))
    owner = np.repeat(np.arange(len(pieces), dtype=kind), sizes + 1)
    left = np.repeat(ends.astype(kind), sizes + 1) - np.arange(len(symbols), dtype=kind)
    order = suffix_array(symbols)
    reach = common_prefixes(symbols, order, left)[order] >= length
    run = np.cumsum(~reach, dtype=kind)
    tied = reach.copy()
    tied[:-1] |= reach[1:]
    place, run = order[tied], run[tied]
    k = owner[place]
    offset = place - (ends[k] - sizes[k])
    at = start[k] + offset
    by = np.lexsort((at, doc[k], run))
    run, k, offset, at = run[by], k[by], offset[by], at[by]
    first = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1])[: len(run)], np.arange(len(run)), 0))
    later = (doc[k] != doc[k[first]]) | (at != at[first])
    return k[later], offset[later]


def _shard_rows(length: int):
    def solved(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """``held`` is in order of key, document and start; equal pieces of a key are sorted once."""
        owners: dict[tuple[int, bytes], tuple[int, int]] = {}
        covered = []
        for key, doc, start, piece in held:
            if owners.setdefault((key, piece), (doc, start)) != (doc, start):
                covered.append((doc, start, start + len(piece)))
        kinds = Counter(key for key, _ in owners)
        kept = [(piece, *owner) for (key, piece), owner in owners.items() if kinds[key] > 1]
        doc, start, end = (np.array(x, np.int64) for x in (zip(*covered, strict=True) if covered else ([], [], [])))
        if kept:
            pieces, own_doc, own_start = zip(*kept, strict=True)
            own_doc, own_start = np.array(own_doc), np.array(own_start)
            k, offset = repeated_windows(list(pieces), own_doc, own_start, length)
            doc, start = np.append(doc, own_doc[k]), np.append(start, own_start[k] + offset)
            end = np.append(end, own_start[k] + offset + length)
        doc, start, end = _runs(doc, start, end)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start << 32 | end, pa.int64())], names=["doc", "loc"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield from solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from solved(held)

    return rows


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            out: list[tuple] = []
            for doc, text, locs in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = np.sort(locs.values.to_numpy()) if locs.is_valid else np.zeros(0, np.int64)
                _, start, end = _runs(np.zeros(len(spans), np.int64), spans >> 32, spans & 0xFFFFFFFF)
                kept, at = [], 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), len(start), hashlib.sha256(rest).hexdigest(), rest, rest.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
            )


def _window_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                docs, starts, windows = [], [], []
                for doc, start, piece in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    for k in range(len(piece) - length + 1):
                        docs.append(doc)
                        starts.append(start + k)
                        windows.append(piece[k : k + length])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(windows, pa.binary())], names=["doc", "start", "piece"])

    return rows


def _hot_spans(pieces: DataFrame, length: int) -> DataFrame:
    """``(doc, loc)`` of the windows of ``pieces(doc, start, piece)`` that also start earlier, by their bytes."""
    windows = materialize(pieces.mapInArrow(_window_rows(length), "doc long, start long, piece binary"), "windows")
    first = windows.groupBy("piece").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).where("first <> last").drop("last")
    later = windows.join(first, "piece").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.select("doc", F.shiftleft("start", 32).bitwiseOR(F.col("start") + length).alias("loc"))


def repeated_spans(docs: DataFrame, length: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc, loc)``: bytes ``loc >> 32`` to ``loc & 0xFFFFFFFF`` of a document go; intervals may overlap."""
    if not GRAM < length < 256:
        raise ValueError(f"length must lie between {GRAM} and 256")
    parts = max(shuffle_partitions(docs.sparkSession), 1)
    rows = docs.mapInArrow(_anchor_rows(length), _ANCHORS).repartition(parts, "h")
    shared = F.count(F.lit(1)).over(Window.partitionBy("h")) > 1  # a row for each slice at most
    rows = rows.withColumn("look", F.when(F.col("kind") == FIRST, shared).otherwise(F.col("kind") != COVERED))
    told = materialize(rows.where(F.col("look") | (F.col("kind") == COVERED)).select("doc", F.when(F.col("look"), F.col("loc")).alias("piece"), F.when(~F.col("look"), F.col("loc")).alias("covered")), "anchors")
    wanted = told.where("piece is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("piece").alias("locs"))
    pieces = materialize(docs.join(wanted, "doc_id").mapInArrow(_piece_rows(length), _PIECES), "pieces")
    hot = materialize(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"), "hot")
    split = not hot.isEmpty()
    shards = (pieces.join(hot, "key", "left_anti") if split else pieces).repartition(parts, "key").sortWithinPartitions("key", "doc", "start")
    found = shards.mapInArrow(_shard_rows(length), "doc long, loc long")
    if split:
        found = found.unionByName(_hot_spans(pieces.join(hot, "key", "left_semi").select("doc", "start", "piece"), length))
    found = materialize(found, "repeats")
    discard(pieces)
    return told.where("covered is not null").select("doc", F.col("covered").alias("loc")).unionByName(found)


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, kept_text)`` for every row of ``docs(doc_id, text)``.

    ``n_spans`` counts maximal removed runs; ``kept`` holds the other bytes of
    the UTF-8 text and ``kept_text`` the same as a text, without characters that
    a cut splits.  Null texts count as empty.  Rows without ``doc_id`` are
    not compared and come back whole.  Rows that repeat a ``doc_id`` must hold
    its text: the row with the smallest SHA-256 is compared, exact repeats of it
    get its result, others come back whole.  Other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    print_ = F.sha2(F.coalesce("text", F.lit("")), 256)
    marks = docs.select("doc_id", print_.alias("mark")).where("doc_id is not null").groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    clashes = materialize(marks.where("lo <> hi"), "clashes")
    told, whole = docs, None
    if not clashes.isEmpty():
        marked = docs.withColumn("mark", print_).join(clashes, "doc_id", "left")
        told = marked.where("lo is null or mark = lo").select("doc_id", "text")
        whole = marked.where("mark <> lo").select("doc_id", "text", F.lit(None).cast("array<long>").alias("locs"))
    spans = repeated_spans(told, length).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("loc").alias("locs"))
    joined = told.join(spans, "doc_id", "left").select("doc_id", "text", "locs")
    return (joined.unionByName(whole) if whole is not None else joined).mapInArrow(_cut_rows, _RESULT)
