"""Run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_report(runs: DataFrame, extraction: DataFrame, chunking: DataFrame, embedding: DataFrame) -> DataFrame:
    """``runs(run_id)`` with the counts of each stage; a stage that never ran counts zero."""
    out = runs
    for stage in (extraction, chunking, embedding):
        counts = [c for c, t in stage.dtypes if c != "run_id" and t in ("int", "bigint", "double")]
        out = out.join(stage, "run_id", "left").fillna(0, counts)
    return out


def pages_cost(pages: DataFrame, per_page: str = "0.01") -> DataFrame:
    return pages.agg((F.count(F.lit(1)).cast("decimal(18,0)") * F.lit(per_page).cast("decimal(6,4)")).alias("cost"))


def observed(rows: DataFrame, name: str, **metrics) -> DataFrame:
    """``rows`` unchanged; the metrics are told with the action that reads them."""
    return rows.observe(name, *(c.alias(k) for k, c in metrics.items()))


def write_report(report: DataFrame, path: str, environment: str) -> bool:
    """One JSON row, in development only; whether it was written is returned."""
    if environment != "Development":
        return False
    report.coalesce(1).write.mode("overwrite").json(path)
    return True


def archive(rows: DataFrame, root: str, run_id: str, stage: str) -> None:
    """The stage's rows of a run, always kept: ``root/stage/run_id=...``."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/{stage}")
