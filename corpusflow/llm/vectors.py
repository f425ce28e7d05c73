"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into its leaf.  A
query walks the tree best bin first: a priority queue holds the branches not
taken with their distance, and leaves are visited in that order.  How many
leaves is calibrated on sample rows kept out of the fit: visits widen until the
wanted recall against brute force is reached; a walk goes on where its leaves
hold too few rows.

The subtrees below the root are regions.  A query goes once to each region where
it visits leaves, with their numbers, and is compared there with the rows of
those leaves alone.  Regions are cut into blocks of bounded size by a hash, and
queries into parts, so neither a leaf that holds a third of all rows nor one that
all queries visit is one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Rows that the tree is fitted on, at most, and bytes of them; queries that calibrate it.
SAMPLE, SAMPLE_BYTES, CALIBRATING = 20_000, 128 << 20, 200
BRANCHES, LEAF_ROWS = 64, 16
#: Recall that calibration asks for, above what is promised.
RECALL = 0.94
#: Rows of a region in one block, and queries that meet a block in one task.
BLOCK_ROWS, PART_QUERIES = 4096, 100_000


class Tree:
    """Nodes hold the centres of their children; a negative child is leaf ``-1 - child``."""

    def __init__(self, rows: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self._grow(rows, branches, leaf_rows)
        self.region = np.zeros(self.leaves, np.int64)
        for k, child in enumerate(self.children[0] if self.children else []):
            self.region[self._under(child)] = k

    def _under(self, node: int) -> list[int]:
        return [-1 - node] if node < 0 else [leaf for child in self.children[node] for leaf in self._under(child)]

    def _grow(self, rows: np.ndarray, branches: int, leaf_rows: int) -> int:
        if len(rows) <= leaf_rows or (rows == rows[0]).all():
            self.leaves += 1
            return -self.leaves
        centres = rows[self._rng.choice(len(rows), min(branches, len(rows)), replace=False)].copy()
        for _ in range(12):
            owner = self._nearest(rows, centres)
            order = np.argsort(owner, kind="stable")
            used, first, size = np.unique(owner[order], return_index=True, return_counts=True)
            centres[used] = np.add.reduceat(rows[order], first, axis=0) / size[:, None]
        owner = self._nearest(rows, centres)
        used = np.flatnonzero(np.bincount(owner, minlength=len(centres)))
        if len(used) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(rows[owner == k], branches, leaf_rows) for k in used]
        return node

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.zeros(len(rows), np.int64)
        if not self.centres:
            return out
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            owner = self._nearest(rows[at], self.centres[node])
            for k, child in enumerate(self.children[node]):
                own = at[owner == k]
                if not len(own):
                    continue
                if child < 0:
                    out[own] = -1 - child
                else:
                    todo.append((child, own))
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves best bin first, and more until they hold ``rows`` rows by ``sizes``."""
        if not self.centres:
            return [0]
        out: list[int] = []
        held, queue = 0, [(0.0, 0)]
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            while node >= 0:
                far = ((self.centres[node] - query) ** 2).sum(axis=1)
                best = int(far.argmin())
                for k, (d, child) in enumerate(zip(far.tolist(), self.children[node], strict=True)):
                    if k != best:
                        heapq.heappush(queue, (d, child))
                node = self.children[node][best]
            out.append(-1 - node)
            held += 0 if sizes is None else int(sizes[-1 - node])
        return out


def calibrate(tree: Tree, queries: np.ndarray, leaves: list[list[int]], recall: float = RECALL) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours, which lie in ``leaves`` of each query, are found."""
    ranks = []
    for q, near in zip(queries, leaves, strict=True):
        order = {v: n for n, v in enumerate(tree.visit(q, tree.leaves))}
        ranks += [order[v] for v in near]
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if ranks else tree.leaves


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _once(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of the first of each repeated (id, row), in order."""
    _, group, size = np.unique(ids, return_inverse=True, return_counts=True)
    seen, keep = set(), np.ones(len(ids), bool)
    for at in np.flatnonzero(size[group] > 1).tolist():
        key = (int(ids[at]), (rows[at] + 0.0).tobytes())
        keep[at] = key not in seen
        seen.add(key)
    return np.flatnonzero(keep)


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return rows, rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries(vec_id, embedding)`` the ``k`` nearest found in ``vectors``.

    Nearness is cosine in double precision; ties go to the smaller ``vec_id``.
    A row is no neighbour of a query with its ``vec_id``.  Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows
    without ``vec_id`` or with another number of components than most valid
    vectors.  A repeated (``vec_id``, vector) counts once.  Queries with fewer
    than ``k`` candidates get them all.  Rows of one ``vec_id`` with other vectors
    are candidates of their own (one result where their scores are equal).  Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    doubles = F.col("embedding").cast("array<double>")
    valid = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("embedding")).where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    vectors, queries = valid(vectors), valid(queries)
    schema = "query_id long, rank int, vec_id long, score double"
    widths = vectors.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths[0]
    vectors, queries = (df.where(F.size("embedding") == width) for df in (vectors, queries))
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    _, rows = _unit(drawn, width)
    tree = Tree(rows)
    region = tree.region

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf_of(_unit(batch.column(1), width)[1])
                yield pa.RecordBatch.from_arrays([pa.array(region[leaf]), pa.array(leaf), *batch.columns], names=["region", "leaf", "vec_id", "embedding"])

    placed = materialize(vectors.mapInArrow(place, "region long, leaf long, vec_id long, embedding array<double>"), "placed")
    counted = placed.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).collect()  # a row for each leaf: bounded by the sample
    sizes = np.zeros(tree.leaves, np.int64)
    sizes[[r["leaf"] for r in counted]] = [r["n"] for r in counted]

    told = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATING).toArrow()
    told_ids = told.column("vec_id").to_numpy()
    told_rows = _unit(told.column("embedding").combine_chunks(), width)[1] if len(told) else np.zeros((0, width))

    def true_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(told_ids):
                continue
            leaf, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            score = told_rows @ _unit(batch.column(3), width)[1].T
            score[told_ids[:, None] == ids[None, :]] = -np.inf
            at = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(at)), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, at.ravel()]), pa.array(leaf[at.ravel()])], names=["q", "score", "leaf"])

    place_of = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    true = placed.mapInArrow(true_rows, "q long, score double, leaf long").where("score > -2").withColumn("r", place_of).where(F.col("r") <= k)
    near: list[list[int]] = [[] for _ in told_ids]
    for r in true.select("q", "leaf").collect():  # k rows for each calibrating query
        near[r["q"]].append(r["leaf"])
    visits = calibrate(tree, told_rows, near, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                which, regions, leaves = [], [], []
                for n, q in enumerate(_unit(part.column(1), width)[1]):
                    seen = np.array(tree.visit(q, visits, sizes, k + 1))
                    for r in np.unique(region[seen]).tolist():
                        which.append(n)
                        regions.append(r)
                        leaves.append(np.sort(seen[region[seen] == r]))
                columns = [pa.array(regions, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), *(c.take(pa.array(which, pa.int64())) for c in part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "leaves", "vec_id", "embedding"])

    parts = max(1, -(-queries.count() // PART_QUERIES))
    blocks = placed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    members = placed.join(F.broadcast(blocks), "region").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))  # a row for each region: at most BRANCHES
    members = members.withColumn("part", every(F.lit(parts).cast("long"))).withColumn("leaves", F.array("leaf"))
    asked = queries.mapInArrow(walk, "region long, leaves array<long>, vec_id long, embedding array<double>").join(F.broadcast(blocks), "region")
    asked = asked.withColumn("block", every(F.col("blocks"))).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long")))

    def compared(have: list[pa.RecordBatch], want: pa.Table) -> Iterator[pa.RecordBatch]:
        """The ``k`` nearest rows to each query, of the leaves that it visits."""
        own = pa.Table.from_batches(have).combine_chunks()
        ids = own.column("vec_id").to_numpy()
        raw, _ = _unit(own.column("embedding").combine_chunks(), width)
        once = _once(ids, raw)
        leaf = own.column("leaves").combine_chunks().flatten().to_numpy()[once]
        order = np.argsort(leaf, kind="stable")
        leaf, ids, raw = leaf[order], ids[once][order], raw[once][order]
        norm = np.sqrt((raw * raw).sum(axis=1))
        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        ends = np.append(starts[1:], len(leaf))
        q_ids = want.column("vec_id").to_numpy()
        q_raw, _ = _unit(want.column("embedding").combine_chunks(), width)
        q_norm = np.sqrt((q_raw * q_raw).sum(axis=1))
        lists = want.column("leaves").combine_chunks()
        visited = lists.flatten().to_numpy()
        asker = np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy())
        by_leaf = np.argsort(visited, kind="stable")
        visited, asker = visited[by_leaf], asker[by_leaf]
        q_out, v_out, s_out = [], [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            lo, hi = np.searchsorted(visited, [leaf[a], leaf[a] + 1])
            if lo == hi:
                continue
            q = asker[lo:hi]
            score = (q_raw[q] @ raw[a:b].T) / (q_norm[q][:, None] * norm[a:b][None, :])
            score[q_ids[q][:, None] == ids[a:b][None, :]] = -np.inf
            n = min(k * int(np.unique(ids[a:b], return_counts=True)[1].max()), b - a)  # rows of one vec_id with equal scores are one result
            least = -np.partition(-score, n - 1, axis=1)[:, n - 1]  # ties at the last place all stay for now
            i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            q_out.append(q[i])
            v_out.append(ids[a + j])
            s_out.append(score[i, j])
        if not q_out:
            return
        q, v, score = (np.concatenate(x) for x in (q_out, v_out, s_out))
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        fresh = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (score[1:] != score[:-1]))[: len(q)]
        q, v, score = q[fresh], v[fresh], score[fresh]
        first = np.append(True, q[1:] != q[:-1])[: len(q)]
        keep = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) < k
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[keep]]), pa.array(v[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("region", "block", "part", "role")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if b == a:
                    continue
                if tuple(keys[a, :3]) != now:
                    now, have = tuple(keys[a, :3]), []
                if keys[a, 3] == 0:  # a block's rows come first and are held, its queries pass by
                    have.append(batch.slice(a, b - a))
                elif have:
                    for at in range(a, b, 512):
                        yield from compared(have, pa.Table.from_batches([batch.slice(at, min(512, b - at))]))

    columns = ["region", "block", "part", "role", "leaves", "vec_id", "embedding"]
    both = members.withColumn("role", F.lit(0)).select(*columns).unionByName(asked.withColumn("role", F.lit(1)).select(*columns))
    dealt = both.repartition(shuffle_partitions(spark), "region", "block", "part").sortWithinPartitions("region", "block", "part", "role", "vec_id")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
