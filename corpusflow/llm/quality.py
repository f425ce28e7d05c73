"""Quality rules and robust multivariate outliers.

Base rules reject short and repetitive documents.  Of the rest, each language
and source gets a minimum-covariance-determinant estimate of location and
scatter of transformed statistics; documents beyond a Mahalanobis distance from
it are rejected.

The estimate is the fast algorithm for large tables: many random starts of few
rows take concentration steps on a bounded sample of each group, and the best
of them go on over all rows until their determinants stand still; the lowest one
is the group's.  A step over all rows is one aggregate: rows are counted and
summed by group and distance bucket, combined before the shuffle, so that the
nearest share of a group and its moments are read off a bounded number of
buckets, and a source with a third of all documents needs no task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels
from .common import discard, flat_bytes, materialize, text_slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]
FEATURES = ["x0", "x1", "x2", "x3", "x4", "x5"]
#: Resolution of the features, added to every scatter (shares are often all zero): log of the mean word length, then square roots of shares.
FLOORS = [0.12, 0.05, 0.08, 0.08, 0.08, 0.06]
#: Share of a group's rows that the estimate rests on.
SUBSET = 0.75
#: Rows of a group's sample, its random starts, and how many of them go on over all rows.
SAMPLE_ROWS, STARTS, CANDIDATES = 500, 60, 2
#: Change of the log determinant at which a fit stands still, and steps over all rows at most.
STILL, STEPS = 0.01, 30
#: Buckets of squared distances for each doubling.
BUCKETS = 32
#: Squared Mahalanobis distance beyond which a document is rejected where labels do not tell: ten spreads, so that the long tails of clean text stay.
CUTOFF = 100.0
#: Share of the documents labelled good that a cutoff may lose, and how many labels it takes to say so.
CLEAN_LOSS, LEAST_LABELS = 0.002, 500
#: Groups with fewer rows take the estimate of their language, languages that of all.
LEAST_ROWS = 100
#: Parts of a group when rows meet their model, so that a group of any size is several tasks.
SALTS = 32

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The ``COUNTS`` of each text of a string column."""
    data, offsets = flat_bytes(column)
    rows = len(offsets) - 1
    start, end, row = kernels.word_spans(data, offsets)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n_words = np.bincount(row, minlength=rows)
    inside = ~kernels.SPACE[data]
    sums = kernels.prefix_hash(data)
    # Lines: their bounds are line feeds and the ends of texts.
    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, feeds, side="right") - 1]), kind="stable")
    line_end = np.append(line_start[1:], len(data))
    same = np.append(line_row[1:] == line_row[:-1], False)
    line_end = np.where(same, line_end - 1, offsets[1:][line_row])
    words = np.append(0, np.cumsum(inside))
    real = words[line_end] > words[line_start]
    line_row, marks = line_row[real], kernels.range_hash(sums, line_start[real], line_end[real])
    marks = kernels.mix(marks + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(marks, return_index=True)
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup = n_lines - np.bincount(line_row[first], minlength=rows)
    # Windows of eight words, told apart by row.
    n_repeat = np.zeros(rows, np.int64)
    if len(start) >= 8:
        hashes = kernels.range_hash(sums, start, end)
        grams = np.zeros(len(hashes) - 7, np.uint64)
        for k in range(8):
            grams += hashes[k : k + len(grams)] * np.uint64(pow(0xA0761D6478BD642F | 1, k + 1, 1 << 64))
        whole = row[7:] == row[: len(grams)]
        at = np.flatnonzero(whole)
        keys = kernels.mix(grams[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, index, count = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[count[index] > 1]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 8, -1)
        n_repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=rows)
    return [n_words, total(inside & ((data & 0xC0) != 0x80)), total(_SYMBOL[data]), n_dup, n_repeat, n_lines, total(_UPPER[data]), total(_DIGIT[data])]


def with_statistics(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the ``COUNTS`` of ``text`` in columns named with ``prefix``."""
    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                counts = statistics(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int64()) for c in counts)], names=schema.names)

    return docs.mapInArrow(rows, schema)


def _features(prefix: str) -> list[Column]:
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}

    def share(a: str, b: str) -> Column:
        return F.sqrt(F.least(F.lit(1.0), c[a] / F.greatest(c[b], F.lit(1.0))))

    return [
        F.log(F.greatest(c["word_chars"], F.lit(1.0)) / F.greatest(c["n_words"], F.lit(1.0))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "word_chars"),
        share("n_digits", "word_chars"),
    ]


def _chi2_cdf(x: float, p: int) -> float:
    term, total = 1.0, 0.0
    for k in range(p // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_MODEL = [f"m{i}" for i in range(len(FEATURES))] + [f"w{i}_{j}" for i, j in _PAIRS]


def _distance() -> Column:
    dev = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    return sum((1 if i == j else 2) * F.col(f"w{i}_{j}") * dev[i] * dev[j] for i, j in _PAIRS)


def _scale() -> float:
    """Makes the scatter of the nearest ``SUBSET`` of normal rows that of all."""
    return SUBSET / _chi2_cdf(chi2_quantile(SUBSET, len(FEATURES)), len(FEATURES) + 2)


def _scatter(cov: np.ndarray) -> np.ndarray:
    return cov * _scale() + np.diag(np.square(FLOORS))


def _steps(x: np.ndarray, subsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log determinant, location and scatter of the rows of ``x`` that each of ``subsets`` names."""
    rows = x[subsets]
    mean = rows.mean(axis=1)
    dev = rows - mean[:, None]
    scatter = _scatter(np.einsum("sni,snj->sij", dev, dev) / rows.shape[1])
    return np.linalg.slogdet(scatter)[1], mean, scatter


def candidates(x: np.ndarray, starts: int = STARTS, keep: int = CANDIDATES, seed: int = 3) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """``(log determinant, location, scatter)`` of the best different fits to ``x``, the lowest determinant first."""
    rng, n = np.random.default_rng(seed), len(x)
    h = min(n, int(np.ceil(SUBSET * n)))

    def concentrated(mean: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dev = x[None] - mean[:, None]
        far = np.einsum("sni,sij,snj->sn", dev, np.linalg.inv(scatter), dev, optimize=["einsum_path", (0, 1), (0, 1)])
        return _steps(x, np.argpartition(far, h - 1, axis=1)[:, :h])

    det, mean, scatter = _steps(x, rng.permuted(np.tile(np.arange(n), (starts, 1)), axis=1)[:, : x.shape[1] + 1])
    for _ in range(2):
        det, mean, scatter = concentrated(mean, scatter)
    best = np.argsort(det, kind="stable")[:10]
    det, mean, scatter = det[best], mean[best], scatter[best]
    for _ in range(50):
        after = concentrated(mean, scatter)
        still = (det - after[0] < 1e-9).all()
        det, mean, scatter = after
        if still:
            break
    done: list[int] = []
    for k in np.argsort(det, kind="stable").tolist():
        if all(abs(det[k] - det[other]) > 1e-6 for other in done):
            done.append(k)
    return [(float(det[k]), mean[k], scatter[k]) for k in done[:keep]]


_MODEL_SCHEMA = "key string, c int, n long, det double, " + ", ".join(f"{c} double" for c in _MODEL)


def _model_row(key: str, c: int, n: int, fit: tuple[float, np.ndarray, np.ndarray]) -> tuple:
    inverse = np.linalg.inv(fit[2])
    return (key, c, n, fit[0], *fit[1].tolist(), *(float(inverse[i, j]) for i, j in _PAIRS))


def _start_rows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    fits = candidates(group[FEATURES].to_numpy(np.float64))
    return pd.DataFrame([_model_row(key[0], c, 0, fit) for c, fit in enumerate(fits)], columns=["key", "c", "n", "det", *_MODEL])


def _fitted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's fit from the sums over its nearest rows."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            n = row["used"]
            mean = np.array([row[f"s{i}"] for i in range(len(FEATURES))]) / n
            cov = np.zeros((len(FEATURES), len(FEATURES)))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = row[f"s{i}_{j}"] / n - mean[i] * mean[j]
            scatter = _scatter(cov)
            out.append(_model_row(row["key"], row["c"], row["n"], (float(np.linalg.slogdet(scatter)[1]), mean, scatter)))
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * (1 + len(_MODEL))]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "c", "n", "det", *_MODEL])


def fit(rows: DataFrame) -> DataFrame:
    """One row of the model for each key of ``rows(key, salt, draw, x0 .. x5)``: location and inverse scatter; ``draw`` orders the sample."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    drawn = F.row_number().over(Window.partitionBy("key").orderBy("draw", *FEATURES))
    sample = rows.select("key", "draw", *FEATURES).withColumn("r", drawn).where(F.col("r") <= SAMPLE_ROWS)
    model = materialize(sample.groupBy("key").applyInPandas(_start_rows, _MODEL_SCHEMA), "model")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS]
    names = [f"s{i}" for i in range(len(FEATURES))] + [f"s{i}_{j}" for i, j in _PAIRS]
    below = Window.partitionBy("key", "c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    model = model.withColumn("moving", F.lit(True))
    for _ in range(STEPS):
        placed = rows.join(model.where("moving").select("key", "c", *_MODEL, salts), ["key", "salt"])
        bucket = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * BUCKETS).cast("int")
        binned = placed.groupBy("key", "c", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)
        before = binned.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("whole", F.sum("n").over(Window.partitionBy("key", "c")))
        near = before.where(F.col("before") < SUBSET * F.col("whole")).groupBy("key", "c").agg(F.first("whole").alias("n"), F.sum("n").alias("used"), *(F.sum(s).alias(s) for s in names))
        after = near.mapInArrow(_fitted_rows, _MODEL_SCHEMA).select("key", "c", F.struct("n", "det", *_MODEL).alias("after"))
        lower = (F.col("n") == 0) | (F.col("after.det") < F.col("det") - STILL)  # the first step counts whatever the sample said
        stepped = model.join(after, ["key", "c"], "left").withColumn("lower", F.col("moving") & lower)
        values = [F.when(F.col("lower"), F.col(f"after.{v}")).otherwise(F.col(v)).alias(v) for v in ("n", "det", *_MODEL)]
        model = materialize(stepped.select("key", "c", *values, F.col("lower").alias("moving")), "model")
        if model.where("moving").isEmpty():
            break
    least = model.groupBy("key").agg(F.min_by(F.struct("n", "det", *_MODEL), F.struct("det", "c")).alias("best"))
    return materialize(least.select("key", "best.*"), "fitted")


def _base_failed(prefix: str) -> Column:
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


def cutoff_of(distances: DataFrame, fallback: float = CUTOFF) -> float:
    """The least bucket bound that at most ``CLEAN_LOSS`` of the good rows of ``distances(distance, good)`` exceed."""
    bucket = F.ceil(F.log2(F.greatest("distance", F.lit(1e-6))) * BUCKETS).alias("bucket")
    rows = distances.where("good and distance is not null").groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred buckets
    total = sum(r["n"] for r in rows)
    if total < LEAST_LABELS:
        return fallback
    beyond, bound = 0, fallback
    for r in sorted(rows, key=lambda r: -r["bucket"]):
        bound = 2.0 ** (r["bucket"] / BUCKETS)
        beyond += r["n"]
        if beyond > CLEAN_LOSS * total:
            break
    return bound


def judge(docs: DataFrame, cutoff: float = CUTOFF, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_q_*`` counts, ``_q_base_failed``, ``_q_distance`` (null if base failed) and ``_q_kept``.

    Reads ``text``, ``lang`` and ``source`` (a missing column counts as null);
    null and empty texts have no words and fail the base rules.  Null languages
    and sources are groups of their own.  All rows come back with all columns;
    repeated rows are judged alike.  With ``labels(doc_id, quality)`` (1: good) the
    cutoff is the one that keeps all but ``CLEAN_LOSS`` of the good documents that
    pass the base rules; fewer than ``LEAST_LABELS`` of these leave ``cutoff`` as it is.
    """
    def prepared(frame: DataFrame) -> DataFrame:
        frame = with_statistics(frame)
        lang, source = ((F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source"))
        keys = {"_q_key": F.concat(F.lit("group "), F.to_json(F.struct(lang, source))), "_q_lang": F.concat(F.lit("language "), F.to_json(F.struct(lang)))}
        return frame.withColumns({**keys, **dict(zip(FEATURES_Q, _features("_q_"), strict=True)), "_q_base_failed": _base_failed("_q_")})

    needed = [c for c in ("text", "lang", "source") if c in docs.columns] + (["doc_id"] if labels is not None else [])
    known = ["doc_id"] if labels is not None else []
    seen = materialize(prepared(docs.select(*needed)).where("not _q_base_failed").select(*known, "_q_key", "_q_lang", *(F.col(q).alias(x) for q, x in zip(FEATURES_Q, FEATURES, strict=True))), "statistics")
    keys = F.explode(F.array("_q_key", "_q_lang", F.lit("all")))
    number = F.monotonically_increasing_id()  # of a written table: the same at every try
    salted = seen.withColumn("number", number).withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int")).withColumn("draw", F.xxhash64("number"))
    model = fit(salted.select(keys.alias("key"), "salt", "draw", *FEATURES))
    groups = seen.select("_q_key", "_q_lang").distinct()
    own, language, every = (model.select(F.col("key").alias(k), F.struct("n", *_MODEL).alias(a)) for k, a in (("_q_key", "own"), ("_q_lang", "language"), ("_q_all", "every")))
    groups = groups.withColumn("_q_all", F.lit("all")).join(own, "_q_key", "left").join(language, "_q_lang", "left").join(every, "_q_all", "left")
    chosen = F.when(F.col("own.n") >= LEAST_ROWS, F.col("own")).when(F.col("language.n") >= LEAST_ROWS, F.col("language")).otherwise(F.col("every"))
    groups = materialize(groups.select("_q_key", chosen.alias("_q_model")), "groups")

    def far(names: list[str]) -> Column:
        dev = [F.col(x) - F.col(f"_q_model.m{i}") for i, x in enumerate(names)]
        return sum((1 if i == j else 2) * F.col(f"_q_model.w{i}_{j}") * dev[i] * dev[j] for i, j in _PAIRS)

    if labels is not None:
        good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        told = seen.select(F.col("doc_id").cast("long").alias("doc_id"), "_q_key", *FEATURES).join(good, "doc_id", "left_semi").join(groups, "_q_key")
        cutoff = cutoff_of(told.select(far(FEATURES).alias("distance"), F.lit(True).alias("good")), cutoff)
    discard(seen)
    judged = prepared(docs).join(groups, "_q_key", "left")
    distance = far(FEATURES_Q)
    judged = judged.withColumn("_q_distance", F.when(~F.col("_q_base_failed"), distance))
    judged = judged.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(F.col("_q_distance") <= cutoff, F.lit(True)))
    return judged.select(*docs.columns, *("_q_" + c for c in COUNTS), "_q_base_failed", "_q_distance", "_q_kept")


FEATURES_Q = ["_q_" + x for x in FEATURES]
