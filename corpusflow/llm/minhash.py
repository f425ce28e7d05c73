"""Near-duplicate detection: one-permutation MinHash with optimal densification.

Every distinct shingle set is hashed once into ``bands * rows`` bins by one
permutation; empty bins borrow from a bin that a universal probe sequence of
the bin picks (optimal densification).  Bins are grouped into bands; documents
that share a band form a bucket, and each bucket gives a star of candidate
edges to its smallest member, so a bucket of m members gives m - 1 pairs.

A star alone may miss a link between two leaves.  Buckets whose members are
not yet in one component therefore get further stars, whose centres are drawn
by a hash with an eightfold larger chance each time until every member has
been a centre; pairs already in one component are left out.  So no candidate
pair between components stays unchecked, and a bucket that hangs together
costs one star.  Every link is confirmed on the full sets, in the join itself:
what two members share is counted there and only links come out, so a group of
many near misses makes no rows.

With ``rows = 8`` and ``bands = 64`` a pair at similarity 0.8 shares no band
with probability 8e-6; pairs at 0.4 share one with probability 0.04.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import discard, flat_bytes, materialize, text_slices
from .components import connected_components

#: Further stars of a bucket of m draw centres with chances 8/m, 64/m, 512/m ...
_WIDEN = 8
_PROBES = 1 << 12


def _probe_table(bins: int) -> np.ndarray:
    grid = np.arange(_PROBES, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
    return (kernels.mix(grid + np.uint64(0x51ED270B)) % np.uint64(bins)).astype(np.int32)


def one_permutation(sets: list[np.ndarray], bins: int, probes: np.ndarray | None = None) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sorted hash sets; ``bins`` is a power of two."""
    probes = _probe_table(bins) if probes is None else probes
    shift = np.uint64(64 - (bins.bit_length() - 1))
    own = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for k, hashes in enumerate(sets):
        at = (hashes >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        own[k, at[first]] = hashes[first]
        full[k, at[first]] = True
    out = own.copy()
    rows, cols = np.nonzero(~full)
    for probe in probes:
        if not rows.size:
            break
        source = probe[cols]
        hit = full[rows, source]
        out[rows[hit], cols[hit]] = own[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):  # practically unreachable
        there = np.flatnonzero(full[r])
        out[r, c] = own[r, there[np.searchsorted(there, c) % len(there)]]
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    cut = signatures.reshape(len(signatures), bands, rows)
    factors = kernels.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salts = kernels.mix(np.arange(7, 7 + bands, dtype=np.uint64))
    return kernels.mix((kernels.mix(cut) * factors).sum(axis=2, dtype=np.uint64) + salts)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signer(size: int, bands: int, rows: int, least: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table(bands * rows)
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = flat_bytes(part.column(1))
                sets = kernels.shingle_sets(*kernels.word_hashes(data, offsets), size)
                big = [k for k, s in enumerate(sets) if len(s) >= least]
                keys: list = [None] * len(sets)
                if big:
                    signatures = one_permutation([sets[k] for k in big], bands * rows, probes)
                    for k, row in zip(big, band_keys(signatures, bands).view(np.int64), strict=True):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(_fingerprint, sets), pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "fingerprint", "keys"],
                )

    return sign


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = kernels.shingle_sets(*kernels.word_hashes(*flat_bytes(part.column(1))), size)
                columns = [part.column(0), pa.array(map(_fingerprint, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "shingles"])

    return rows


def _linked(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(f"{a}.shingles", f"{b}.shingles"))
    return both * (100 + percent) >= percent * (F.size(f"{a}.shingles") + F.size(f"{b}.shingles"))


def _alike(a: str, b: str, percent: int) -> Column:
    """What every linked pair meets: sizes in proportion."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return 100 * small >= percent * large


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 64, rows: int = 8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set
    holds its distinct ``size``-word shingles (fewer words: the whole sequence).
    Documents with ``100 * |A and B| >= percent * |A or B|`` are linked;
    ``component_id`` is the smallest ``doc_id`` reachable, ``kept`` marks it.

    Null or wordless texts have an empty set and are linked with nothing.  Rows
    that repeat a ``doc_id`` all come back and hang together: each of its texts is
    linked by what it holds, and all of them have one component.  Rows without
    ``doc_id`` take no part: their component is null and they are kept.  Other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = -(-percent // max(1, 100 - percent)) if percent < 100 else 1 << 62
    schema = "doc_id long, n_shingles long, fingerprint binary, keys array<long>"
    signed = materialize(docs.mapInArrow(_signer(size, bands, rows, least), schema).withColumn("row", F.monotonically_increasing_id()), "signed")
    repeats = not signed.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # Equal sets first: they are one node, in the order of its smallest doc_id.
    sets = signed.where("doc_id is not null and n_shingles > 0").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    sets = sets.select("fingerprint", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"))
    if repeats:  # a doc_id may be the first of several sets, so it cannot name them
        sets = sets.repartitionByRange("rep", "row").sortWithinPartitions("rep", "row").withColumn("node", F.monotonically_increasing_id())
    else:
        sets = sets.withColumn("node", F.col("rep"))
    sets = materialize(sets, "sets")
    members = materialize(signed.select("doc_id", "n_shingles", "fingerprint").join(sets.select("fingerprint", "node"), "fingerprint", "left").drop("fingerprint"), "members")
    signs = signed.where("keys is not null").select("row", "n_shingles", "keys").join(sets.select("row", "node"), "row")
    keyed = signs.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    buckets = materialize(keyed.join(shared.drop("last"), "key").select("key", "m", "centre", "node"), "buckets")
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("m")
    level = F.when(F.col("node") == F.col("centre"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(float(_WIDEN), F.greatest(chance, F.lit(1.0))))))
    buckets = buckets.withColumn("level", level.cast("int"))
    nodes = sets.join(buckets.select("node").distinct(), "node", "left_semi")
    nodes = materialize(nodes.join(signed.select("row", "n_shingles"), "row").select("node", "rep", "fingerprint", "n_shingles"), "nodes")
    discard(signed)
    texts = docs.join(nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_set_rows(size), "doc_id long, fingerprint binary, shingles array<long>")
    if repeats:
        texts = texts.join(nodes.select(F.col("rep").alias("doc_id"), "fingerprint", "node"), ["doc_id", "fingerprint"]).select("node", "shingles").dropDuplicates(["node"])
    else:
        texts = texts.select(F.col("doc_id").alias("node"), "shingles")
    looked_at = materialize(texts.join(nodes.select("node", "n_shingles"), "node"), "looked-at")
    sizes = nodes.select("node", "n_shingles")
    stars = buckets.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    stars = stars.join(sizes.alias("a"), F.col("u") == F.col("a.node")).join(sizes.alias("b"), F.col("v") == F.col("b.node"))
    stars = materialize(stars.where(_alike("a", "b", percent)).select("u", "v"), "stars")
    stars = stars.join(looked_at.alias("a"), F.col("u") == F.col("a.node")).join(looked_at.alias("b"), F.col("v") == F.col("b.node"))
    links = stars.where(_linked("a", "b", percent)).select("u", "v")
    if repeats:
        several = members.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").drop("last")
        links = links.unionByName(members.where("node is not null").join(several, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v"))
    links = materialize(links, "links")
    deepest = buckets.agg(F.max("level")).first()[0] or 0
    found = connected_components(links)
    for depth in range(1, deepest + 1):
        placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("level").alias("last"))
        mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("last") >= depth)).select("key")
        open_ = materialize(placed.where(F.col("level") >= depth).join(mixed, "key", "left_semi").join(looked_at, "node"), "open")
        a, b = open_.where(F.col("level") == depth).alias("a"), open_.alias("b")
        later = (F.col("b.level") > F.col("a.level")) | (F.col("b.node") > F.col("a.node"))
        near = later & _alike("a", "b", percent) & _linked("a", "b", percent)
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & near)
        more = materialize(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), "links")
        discard(open_)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = connected_components(links)
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeats:
        placed = placed.join(sets.select(F.col("node").alias("component"), "rep"), "component", "left").withColumn("component", F.col("rep"))
    component = F.coalesce("component", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
