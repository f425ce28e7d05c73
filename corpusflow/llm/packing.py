"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Each piece goes where the sum over gaps of the squared number of open bins with
that gap becomes smallest, a new bin included.  Pieces are dealt to shards by a
hash of what they are, so a shard is a fair sample of sizes and its waste is a
few bins out of tens of thousands; shards grow in number, not in size.  When a
shard is through, its bins with room are dissolved and their pieces placed
again, largest first, and the better of the two packings stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .tokens import BPE_JSON, json_ids

SHARD_PIECES = 200_000
#: Times that open bins are dissolved, and shares of the pieces that come last in turn (0: all come largest first).
ROUNDS, LAST_SHARES = 40, (0.0, 0.1, 0.3)


def sum_of_squares(sizes: list[int], room: int) -> list[int]:
    """A bin number for each size (1 to ``room``), in the given order of arrival."""
    count = np.zeros(room + 1, np.float64)
    count[0] = -0.5  # a gap of nothing is no open bin: its square never counts
    unused = np.where(np.arange(room + 1) > 0, np.inf, 0.0)
    bins: list[list[int]] = [[] for _ in range(room + 1)]
    out, made = [], 0
    for size in sizes:
        if size == room:
            out.append(made)
            made += 1
            continue
        change = count[: room - size] - count[size:room] + unused[size:room]
        best = int(change.argmin())
        if 2 * change[best] + 2 <= 2 * count[room - size] + 1:
            gap = best + size
            chosen = bins[gap].pop()
            count[gap] -= 1
            if not bins[gap]:
                unused[gap] = np.inf
        else:
            gap, chosen, made = room, made, made + 1
        rest = gap - size
        if rest:
            bins[rest].append(chosen)
            count[rest] += 1
            unused[rest] = 0.0
        out.append(chosen)
    return out


def _arrival(sizes: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Places of ``sizes`` in an order of arrival: any, but the smallest ``share`` last in decreasing order (0: all in it)."""
    falling = np.argsort(-sizes, kind="stable")
    last = int(len(sizes) * share)
    return np.concatenate([rng.permutation(falling[: len(falling) - last]), falling[len(falling) - last :]]) if share else falling


def _placed(sizes: np.ndarray, room: int, share: float, rng: np.random.Generator) -> np.ndarray:
    order = _arrival(sizes, share, rng)
    chosen = np.empty(len(sizes), np.int64)
    chosen[order] = sum_of_squares(sizes[order].tolist(), room)
    return chosen


def pack(sizes: list[int], room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it for each size."""
    sizes, rng = np.array(sizes, np.int64), np.random.default_rng(5)
    chosen = _placed(sizes, room, LAST_SHARES[1], rng)
    for turn in range(rounds):
        level = np.bincount(chosen, weights=sizes)
        open_, full = np.flatnonzero(level < room), np.flatnonzero(level == room)
        if len(open_) <= 1:
            break
        taken = np.append(open_, rng.choice(full, min(len(full), len(open_) * int(rng.integers(1, 6))), replace=False))
        at = np.flatnonzero(np.isin(chosen, taken))
        again = _placed(sizes[at], room, LAST_SHARES[turn % len(LAST_SHARES)], rng)
        if again.max() + 1 <= len(taken):
            chosen[at] = len(level) + again
            chosen = np.unique(chosen, return_inverse=True)[1]
    order = np.argsort(chosen, kind="stable")
    ends = np.cumsum(sizes[order])
    begins = ends - sizes[order]
    first = np.flatnonzero(np.append(True, chosen[order][1:] != chosen[order][:-1]))[: len(order)]
    places = np.empty(len(sizes), np.int64)
    places[order] = begins - np.repeat(begins[first], np.diff(np.append(first, len(order))))
    return chosen, places


def _piece_rows(path: str, room: int, end_id: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(json_ids(text or "", path), end_id).astype("<u4")
                    start, stop, piece = 0, len(ids) % room or min(room, len(ids)), 0
                    while start < len(ids):
                        data = ids[start:stop].tobytes()
                        out.append((doc, piece, start, stop - start, zlib.crc32(data), data if with_ids else None))
                        start, stop, piece = stop, stop + room, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows


def pack_documents(docs: DataFrame, room: int = 2048, tokenizer: str = BPE_JSON, end_id: int = 0, with_ids: bool = False, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)``: every piece of ``docs(doc_id, text)`` and its place.

    A document is its token ids and then ``end_id``; one longer than ``room``
    is cut into pieces of ``room`` tokens, only the first of which may be
    shorter.  ``ids`` (little-endian unsigned 32-bit) is null unless ``with_ids``.
    Null and empty texts are the end id alone.  Rows are packed one by one: a
    repeated or null ``doc_id`` is no special case.  Other columns are ignored;
    an empty table gives no rows.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _piece_rows(tokenizer, room, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    carried = [c for c in pieces.columns if c != "ids"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        chosen, places = pack(group["length"].tolist(), room)
        group["sequence_id"] = chosen + (group["shard"].to_numpy(np.int64) << 32)
        group["offset"] = places
        return group[[*carried, "sequence_id", "offset"]]

    dealt = pieces.select(*carried, F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"
    placed = dealt.groupBy("shard").applyInPandas(place, schema)
    if with_ids:  # these are large and take no part in the packing
        placed = placed.join(pieces.select("row", "ids"), "row")
    else:
        placed = placed.withColumn("ids", F.lit(None).cast("binary"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
