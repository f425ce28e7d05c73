"""Data quality: counts, checks, reconciliation and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blank

#: Thresholds in percent.
MAX_ERROR_RATE, MAX_MAGNITUDE, MAX_DRIFT = 1.0, 20.0, 15.0
TRIGRAM_REPEATS, TRIGRAM_WORDS = 3, 30
LOW_CONFIDENCE = 0.85


def replacement_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))


def bad_chars(text: Column) -> Column:
    """Control and unassigned characters but for line feed, return and tab."""
    return F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cn}&&[^\n\r\t]]"))


def foreign_language(language: Column, prefix: str = "nl") -> Column:
    return ~blank(language) & ~F.lower(language).startswith(prefix)


def _tables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?md)(?:^[ \t]*\|[^\n]*\|[ \t]*(?:\n|\z)){2,}"), F.lit(0))


def table_count(text: Column) -> Column:
    return F.size(_tables(text))


def inconsistent_table(text: Column) -> Column:
    """Whether a run of table rows has rows with different numbers of bars."""
    def bars(block: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda r: r.rlike(r"\S"))
        return F.array_distinct(F.transform(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit("")))))

    return F.exists(_tables(text), lambda b: F.size(bars(b)) > 1)


def has_heading(text: Column) -> Column:
    return text.rlike(r"(?md)^#{1,6} ")


def unbalanced_tables(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<table\b")) != F.regexp_count(html, F.lit(r"(?i)</table\s*>"))


def repeated_trigrams(pages: DataFrame, keys: list[str], text: str = "text", top: int = 3) -> DataFrame:
    """Three-word phrases that occur at least three times on a page of thirty words, the ``top`` most frequent.

    A page is counted within its row: its phrases are sorted and their runs measured.
    Pages that ``keys`` do not tell apart are ranked each by itself.  With a column
    ``table_count``, pages with a table are skipped: cells repeat by nature.
    """
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    phrases = lambda w: F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1), F.get(w, k + 2))))
    places = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def runs(s: Column) -> Column:
        measured = F.transform(F.array(places(s)), lambda p: F.transform(p, lambda at, k: F.struct((at - F.coalesce(F.get(p, k + 1), F.size(s))).alias("less"), F.get(s, at).alias("phrase"))))
        return F.slice(F.array_sort(F.filter(F.get(measured, 0), lambda r: r["less"] <= -TRIGRAM_REPEATS)), 1, top)

    shown = pages.where(F.coalesce(F.col("table_count") == 0, F.lit(True))) if "table_count" in pages.columns else pages
    found = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= TRIGRAM_WORDS, F.get(F.transform(F.array(phrases(w)), runs), 0))), 0)
    rows = shown.select(*keys, F.posexplode(found).alias("k", "run"))
    return rows.select(*keys, F.col("run.phrase").alias("phrase"), (-F.col("run.less")).cast("long").alias("n"), (F.col("k") + 1).alias("rank"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def all_blank(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Documents all of whose pages lack a field."""
    return rows.groupBy(key).agg(F.bool_and(blank(F.col(column))).alias("missing")).where("missing").select(key)


def without_headings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return rows.groupBy(key).agg(F.bool_or(has_heading(F.col(text))).alias("found")).where(~F.col("found")).select(key)


def error_rate(errors: Column, attempted: Column) -> Column:
    return F.when(attempted == 0, 100.0).otherwise(100.0 * errors / attempted)


def magnitude_shift(now: Column, before: Column) -> tuple[Column, Column]:
    """Change in percent (null without a positive count before) and whether it is too large."""
    shift = F.when(before > 0, 100.0 * (now - before) / before)
    return shift, F.coalesce(F.abs(shift) > MAX_MAGNITUDE, F.lit(False))


def index_drift(now: Column, base: Column) -> tuple[Column, Column]:
    drift = F.when(base > 0, (now - base) / base)
    return drift, F.coalesce(F.abs(drift) > MAX_DRIFT / 100, F.lit(False))


def reconcile(counts: DataFrame) -> DataFrame:
    """One row of stage counts, with the list of ``problems``: every row must be accounted for at each step.

    Reads ``parsed, joined, missing_pages, inactive_pages, records, clean_errors, duplicates``.
    """
    checks = [
        (F.col("parsed") != F.col("joined") + F.col("missing_pages") + F.col("inactive_pages"), "parse to join"),
        (F.col("joined") != F.col("records") + F.col("clean_errors") + F.col("duplicates"), "join to clean"),
        (F.col("records") == 0, "no records"),
    ]
    return counts.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in checks))))


def gate(rate: Column, problems: Column, magnitude_flag: Column, override: bool = False, magnitude_gates: bool = True) -> Column:
    """Whether a run may go on; an override excuses the magnitude only."""
    sound = (rate <= MAX_ERROR_RATE) & (F.size(problems) == 0)
    return sound if override or not magnitude_gates else sound & ~magnitude_flag


def issues(frames: list[tuple[str, str, DataFrame]], most: int | None = None) -> DataFrame:
    """Issues of all stages: ``(stage, severity, document_id, message, reason)``; ``most`` limits a report."""
    tagged = [f.select(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.col("document_id").cast("string").alias("document_id"), "message", "reason") for stage, severity, f in frames]
    out = reduce(DataFrame.unionByName, tagged)
    return out if most is None else out.orderBy("stage", "severity", "document_id", "message").limit(most)


def severity_counts(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.agg(F.count_if(F.col("severity") == "Error").alias("n_errors"), F.count_if(F.col("severity") != "Error").alias("n_warnings"))


def spot_check(rows: DataFrame, key: str, n: int = 5, seed: str = "spot") -> DataFrame:
    """A sample that is the same at every run: the ``n`` smallest hashes of the key."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)
