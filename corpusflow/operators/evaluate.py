"""Evaluation of answers against expected ones."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import citation_match, guids

#: The gate, prices of a million tokens, and tries of a judge.
LEAST_GROUNDED, PRICE_IN, PRICE_OUT, TRIES = 3.0, 2.0, 8.0, 5
SCORES = ["groundedness", "relevance", "coherence", "equivalence", "retrieval"]


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "), " "), lambda w: w != "")


def token_f1(rows: DataFrame, key: str, answer: str, expected: str, answerable: str | None = None) -> DataFrame:
    """``(key, f1)`` by the multiset of words that both have; -1 where the column ``answerable`` is false."""
    if answerable is not None:
        able = F.coalesce(F.col(answerable), F.lit(True))
        return token_f1(rows.where(able), key, answer, expected).unionByName(rows.where(~able).select(key, F.lit(-1.0).alias("f1")).distinct())
    sides = [rows.select(key, F.explode(word_list(F.col(c))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias(n)) for c, n in ((answer, "a"), (expected, "e"))]
    both = sides[0].join(sides[1], [key, "word"], "full_outer")
    told = both.groupBy(key).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("e", F.lit(0)))).alias("s"), F.sum("a").alias("a"), F.sum("e").alias("e"))
    f1 = F.when(F.col("s") > 0, 2.0 * F.col("s") / (F.col("a") + F.col("e"))).otherwise(0.0)
    return rows.select(key).distinct().join(told.select(key, f1.alias("f1")), key, "left").select(key, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def citation_scores(rows: DataFrame, expected: str, cited: str) -> DataFrame:
    return rows.withColumn("citation_match", citation_match(guids(F.col(expected)), guids(F.col(cited))))


def _ask(judge: Callable[..., dict[str, float]], asked: tuple, wait: Callable[[float], None]) -> dict[str, float]:
    """A busy judge is asked again, after the seconds it names or longer each time."""
    for n in range(TRIES):
        try:
            return judge(*asked)
        except Exception as error:
            if getattr(error, "status", None) != 429 or n == TRIES - 1:
                raise
            named = getattr(error, "retry_after", None)
            wait(2 ** (n + 2) if named is None else named)


def judged(rows: DataFrame, judge: Callable[[str, str, str], dict[str, float]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows(query, answer, context)`` with the judge's scores; a failure scores zero and is marked."""
    def run(frames):
        for frame in frames:
            out = []
            for q, a, c in zip(frame["query"], frame["answer"], frame["context"], strict=True):
                try:
                    told = _ask(judge, (q, a, c), wait)
                    out.append([*(float(told[s]) for s in SCORES), True])
                except Exception:  # a judge's failure is the row's
                    out.append([0.0] * len(SCORES) + [False])
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=[*SCORES, "succeeded"])], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, kinds + "".join(f", {s} double" for s in SCORES) + ", succeeded boolean")


def passes(succeeded: Column, groundedness: Column) -> Column:
    return succeeded & (groundedness >= LEAST_GROUNDED)


def cost_usd(input_tokens: Column, output_tokens: Column) -> Column:
    return (input_tokens * PRICE_IN + output_tokens * PRICE_OUT) / 1_000_000
