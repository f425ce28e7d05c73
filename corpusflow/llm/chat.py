"""Chat transcripts: a hidden Markov model recovers roles, then turns are rendered canonically.

A transcript is lines of text; some carry a speaker marker ("User:", "Bot -"),
many do not.  States are the roles, each as first line of a turn or as a later
one.  Emissions are a line's features: the role that its marker suggests, a
question mark, its length class, whether it opens with a capital.  Chances are
counted on a bounded sample of labelled lines.

Conversations are decoded in sorted streams, many at once.  Only those longer
than a segment are split: each segment becomes a max-plus matrix of the best
score from any state before it to any state at its end; the matrices of a
conversation are chained to fix the state at each border; then its segments are
decoded like conversations of their own.  A conversation of any length thus
never meets in one task but for one small matrix a segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

ROLES = ("system", "user", "assistant")
STATES = tuple((role, first) for role in ROLES for first in (True, False))
#: Lines that the chances are counted on, at most, lines of a segment, and lines that are decoded together.
SAMPLE, SEGMENT, TOGETHER = 50_000, 512, 1 << 16
#: What speakers are called in transcripts.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "you", "prompter"),
    "assistant": ("assistant", "bot", "ai", "answer", "a", "agent", "model", "gpt", "support"),
}
_ROLE_OF = {word: role for role, words in MARKERS.items() for word in words}
_MARKER = re.compile(r"^\s*[\[<*#]{0,3}\s*([A-Za-z]{1,12})\s*[\]>*]{0,3}\s*[:\-]\s*(?:\*\*)?\s*")


def parse_line(line: str) -> tuple[str, int]:
    """The line without a speaker marker, and its feature number."""
    m = _MARKER.match(line)
    role = _ROLE_OF.get(m[1].lower()) if m else None
    body = line[m.end() :] if role else line
    marker = 0 if role is None else 1 + ROLES.index(role)
    size = 0 if len(body) < 40 else 1 if len(body) < 160 else 2
    return body, ((marker * 2 + ("?" in body)) * 3 + size) * 2 + body[:1].isupper()


FEATURES = 4 * 2 * 3 * 2


class Model:
    """Log chances of starts, transitions and features, with one added to each count."""

    def __init__(self, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray):
        allowed = np.array([[second[1] or second[0] == first[0] for second in STATES] for first in STATES])
        self.start = np.where([first for _, first in STATES], np.log((starts + 1) / (starts + 1).sum()), -1e9)
        counts = np.where(allowed, steps + 0.5, 0)
        with np.errstate(divide="ignore"):
            self.step = np.maximum(np.log(counts / counts.sum(axis=1, keepdims=True)), -1e9)
        self.emit = np.log((emits + 0.5) / (emits + 0.5).sum(axis=1, keepdims=True))

    def _forward(self, features: list[np.ndarray], score: np.ndarray, back: list[np.ndarray] | None) -> np.ndarray:
        """Best scores at the last line of each sequence (the longest first), from ``score`` (sequence, origin, state) at the first."""
        sizes = np.array([len(f) for f in features])
        for t in range(1, sizes[0]):
            live = int(np.searchsorted(-sizes, -t))  # sequences longer than t
            now = np.array([f[t] for f in features[:live]])
            through = score[:live, :, :, None] + self.step
            if back is not None:
                back.append(through[:, 0].argmax(axis=1).astype(np.uint8))
            score[:live] = through.max(axis=2) + self.emit[:, now].T[:, None, :]
        return score

    def matrices(self, features: list[np.ndarray], first: list[bool]) -> np.ndarray:
        """For each sequence the best score from each state before it (``first``: from the start) to each state at its last line."""
        order = np.argsort([-len(f) for f in features], kind="stable")
        heads = self.emit[:, [features[k][0] for k in order]].T
        score = np.where(np.array(first)[order, None, None], self.start, self.step) + heads[:, None, :]
        out = np.empty_like(score)
        out[order] = self._forward([features[k] for k in order], score, None)
        return out

    def decode(self, features: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """The best states of each sequence, given the state before it (-1: a start) and at its last line (-1: any)."""
        order = np.argsort([-len(f) for f in features], kind="stable")
        sizes = np.array([len(features[k]) for k in order])
        head = np.where((before[order] < 0)[:, None], self.start, self.step[before[order]]) + self.emit[:, [features[k][0] for k in order]].T
        back: list[np.ndarray] = []
        score = self._forward([features[k] for k in order], head[:, None, :], back)[:, 0]
        at = np.where(after[order] < 0, score.argmax(axis=1), after[order])
        states = np.zeros((len(order), sizes[0]), np.uint8)
        for t in range(sizes[0] - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t))
            states[:live, t] = at[:live]
            if t:
                at[:live] = back[t - 1][np.arange(live), at[:live]]
        out: list = [None] * len(order)
        for row, k in enumerate(order):
            out[k] = states[row, : sizes[row]]
        return out


_PARSED = "conv_id long, n long, body string, feature int, role string, first boolean"


def parse(lines: DataFrame) -> DataFrame:
    """``(conv_id, n, body, feature, role, first)`` from ``lines(conv_id, n, line)``; ``role`` and ``first`` are null if it has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_line(line or "") for line in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([b for b, _ in parsed], pa.string()), pa.array([f for _, f in parsed], pa.int32()), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n", "body", "feature", "role", "first"])

    told = [F.col(c) if c in lines.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("role", "string"), ("first", "boolean"))]
    return lines.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("n").cast("long").alias("n"), "line", *told).mapInArrow(rows, _PARSED)


def fit(parsed: DataFrame, sample: int = SAMPLE) -> Model:
    """From labelled rows of :func:`parse`: whole conversations, the smallest by hash, at most ``sample`` lines; only numbers reach the driver."""
    number = {s: k for k, s in enumerate(STATES)}
    state = F.coalesce(*(F.when((F.col("role") == role) & (F.col("first") == F.lit(first)), k) for (role, first), k in number.items()), F.lit(-1))
    rows = parsed.select("conv_id", "n", state.alias("state"), "feature").orderBy(F.xxhash64("conv_id"), "conv_id", "n").limit(sample).toArrow()
    conv, states, features = (rows.column(c).to_numpy() for c in ("conv_id", "state", "feature"))
    known = states >= 0
    emits = np.zeros((len(STATES), FEATURES))
    np.add.at(emits, (states[known], features[known]), 1)
    follows = np.zeros(len(conv), bool)
    follows[1:] = known[1:] & known[:-1] & (conv[1:] == conv[:-1])
    at = np.flatnonzero(follows)
    steps = np.zeros((len(STATES), len(STATES)))
    np.add.at(steps, (states[at - 1], states[at]), 1)
    return Model(np.bincount(states[known & ~follows], minlength=len(STATES)), steps, emits)


def _sequences(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole ``(conv_id, segment)`` runs of a sorted stream, about ``together`` lines at once, and where each begins."""
    held: list[pa.RecordBatch] = []
    size = 0

    def told(table: pa.Table, last: bool) -> tuple[pa.Table | None, np.ndarray, pa.Table | None]:
        conv, segment = (table.column(c).to_numpy() for c in ("conv_id", "segment"))
        starts = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (segment[1:] != segment[:-1])))
        if last:
            return table, starts, None
        cut = int(starts[-1])
        return (table.slice(0, cut) if cut else None), starts[:-1], table.slice(cut)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= together:
            done, starts, rest = told(pa.Table.from_batches(held), False)
            if done is not None:
                yield done, starts
            held, size = rest.to_batches(), 0 if done is None else rest.num_rows
    if held:
        done, starts, _ = told(pa.Table.from_batches(held), True)
        yield done, starts


def recover_roles(parsed: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, n, body, role, first)`` for every row of :func:`parse`, by Viterbi over each conversation in order of ``n``.

    ``n`` numbers a conversation's lines from 0 without gaps; null lines count as
    empty.  Rows without ``conv_id`` are one conversation; an empty table gives no rows.
    """
    spark = parsed.sparkSession
    numbers = parsed.select("conv_id", "n", "feature")
    longer = materialize(numbers.groupBy("conv_id").agg(F.max("n").alias("last")).where(F.col("last") >= segment).select("conv_id"), "longer")
    none = F.lit(-1)
    rows = parsed.select("conv_id", "n", "body", "feature")
    if longer.isEmpty():
        rows = rows.withColumns({"segment": F.lit(0).cast("long"), "before": none, "after": none})
    else:
        cut = rows.join(longer, "conv_id", "left_semi").withColumn("segment", F.floor(F.col("n") / segment))
        parts = cut.select("conv_id", "segment", "n", "feature").repartition(shuffle_partitions(spark), "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "n")

        def matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in _sequences(batches):
                own = np.split(table.column("feature").to_numpy(), starts[1:])
                segments = table.column("segment").to_numpy()[starts]
                found = model.matrices(own, (segments == 0).tolist())
                yield pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks().take(pa.array(starts)), pa.array(segments), pa.array(found.reshape(len(starts), -1).tolist(), pa.list_(pa.float64()))], names=["conv_id", "segment", "matrix"])

        def borders(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("segment")
            every = np.stack(group["matrix"].to_list()).reshape(-1, len(STATES), len(STATES))
            score, back = every[0, 0], []
            for own in every[1:]:
                through = score[:, None] + own
                back.append(through.argmax(axis=0))
                score = through.max(axis=0)
            at = int(score.argmax())
            ends = [at]
            for b in reversed(back):
                at = int(b[at])
                ends.append(at)
            ends = ends[::-1]
            return pd.DataFrame({"conv_id": key[0], "segment": group["segment"].to_numpy(), "before": [-1, *ends[:-1]], "after": ends})

        fixed = parts.mapInArrow(matrix_rows, "conv_id long, segment long, matrix array<double>").groupBy("conv_id").applyInPandas(borders, "conv_id long, segment long, before int, after int")
        short = rows.join(longer, "conv_id", "left_anti").withColumns({"segment": F.lit(0).cast("long"), "before": none, "after": none})
        rows = short.unionByName(cut.join(fixed, ["conv_id", "segment"]).select(*short.columns))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles = pa.array([role for role, _ in STATES])
        firsts = pa.array([first for _, first in STATES])
        for table, starts in _sequences(batches):
            own = np.split(table.column("feature").to_numpy(), starts[1:])
            states = pa.array(np.concatenate(model.decode(own, table.column("before").to_numpy()[starts], table.column("after").to_numpy()[starts])))
            columns = [*(table.column(c).combine_chunks() for c in ("conv_id", "n", "body")), roles.take(states), firsts.take(states)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n", "body", "role", "first"])

    dealt = rows.repartition(shuffle_partitions(spark), "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "n")
    return dealt.mapInArrow(decoded, "conv_id long, n long, body string, role string, first boolean")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n, line, role, first)``: the turns of ``conversations(conv_id, turn, role, text)`` as lines of a transcript.

    Turns are in order of ``turn``, then text; a marker stands before the first
    lines of two thirds of the turns (by hash).  Rows without ``conv_id`` or
    ``turn`` take no part; null texts are empty lines; roles other than those of
    the model stay as they are.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9))
    speaker = F.when(F.col("role") == "user", F.when(mark < 2, "User: ").when(mark < 4, "Human: ").when(mark < 6, "Q: ")).when(
        F.col("role") == "assistant", F.when(mark < 2, "Assistant: ").when(mark < 4, "Bot - ").when(mark < 6, "A: ")
    )
    speaker = F.coalesce(speaker, F.when((F.col("role") == "system") & (mark < 6), "System: "), F.lit(""))
    split = rows.select("conv_id", "turn", "role", F.posexplode(F.split(F.concat(speaker, F.col("text")), "\n")).alias("k", "line"))
    # Number lines by block of turns: sizes of earlier blocks, then places within one.
    block = F.floor(F.col("turn") / 256)
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "k", "line")
    placed = split.withColumn("block", block).withColumn("at", F.row_number().over(own) - 1)
    sizes = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return placed.join(sizes, ["conv_id", "block"]).select("conv_id", (F.col("base") + F.col("at")).alias("n"), "line", "role", (F.col("k") == 0).alias("first"))


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, rendered)`` from ``(conv_id, n, body, role, first)``: ``<|role|>``, the turn's lines, ``<|end|>``; turns count from 0."""
    block = F.floor(F.col("n") / 4096)
    rows = turns.withColumn("block", block)
    within = Window.partitionBy("conv_id", "block").orderBy("n")
    counts = rows.groupBy("conv_id", "block").agg(F.sum(F.col("first").cast("long")).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    rows = rows.withColumn("own", F.sum(F.col("first").cast("long")).over(within)).join(counts, ["conv_id", "block"])
    rows = rows.withColumn("turn", F.col("base") + F.col("own") - 1)
    told = rows.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("n", "body"))).alias("lines"))
    text = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.array_join(F.transform("lines", lambda x: x["body"]), "\n"), F.lit("<|end|>\n"))
    return told.select("conv_id", "turn", "role", text.alias("rendered"))
