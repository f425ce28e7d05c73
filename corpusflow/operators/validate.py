"""Validation reports of whole runs: issues of every stage, red flags, counts; statistics of the index and their drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages, projections, quality, store, structure

#: (severity, condition, message, reason)
Check = tuple[str, Column, Column, str]


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def told(rows: DataFrame, stage: str, key: str, checks: list[Check]) -> DataFrame:
    """An issue for each row and check that holds, in one pass over ``rows``."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), m.alias("message"), F.lit(r).alias("reason"))) for s, c, m, r in checks)))
    return rows.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("document_id"), F.explode(found).alias("i")).select("stage", "i.severity", "document_id", "i.message", "i.reason")


def _damage(text: Column) -> list[tuple[Column, str]]:
    return [(quality.replacement_chars(text), "replacement character(s)"), (quality.bad_chars(text), "control or unassigned character(s)")]


def export_issues(parsed: DataFrame, index: DataFrame, joined: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Issues ``(stage, severity, document_id, message, reason)`` of an export run, of both files, the join, the cleaning and the texts."""
    unread = [("Error", F.col("error").isNotNull(), _text("Row ", F.col("row_no"), ": ", F.col("error")), "parse")]
    good = index.where("error is null")
    page = _text("Page ", F.col("page_index"), ": ")
    first, status = F.col("reported"), F.col("status")
    text = F.col("content")
    frames = [
        told(parsed, "Parse:Pages", "document_id", unread),
        told(index, "Parse:Index", "document_id", unread),
        told(joined, "Join", "document_id", [("Error", first & (status == "missing"), F.lit("no index row"), "missing"), ("Warning", first & (status == "inactive"), F.lit("the document is inactive"), "inactive")]),
        told(pages.index_lookup(good), "Join", "document_id", [("Warning", F.col("duplicates") > 0, _text(F.col("duplicates"), " further index row(s), the first counts"), "duplicate")]),
        told(pages.index_without_pages(parsed.where("error is null"), good), "Join", "document_id", [("Warning", F.lit(True), F.lit("no pages: the document will not be indexed"), "unpaged")]),
        told(cleaned, "Clean", "document_id", [
            ("Error", F.col("outcome") == "error", _text(page, "cannot read ", F.col("reason")), "value"),
            ("Warning", F.col("outcome") == "duplicate", _text(page, "repeated"), "duplicate"),
            ("Warning", F.col("warning").isNotNull(), _text(page, F.col("warning")), "blank"),
        ]),
        told(cleaned.where("outcome = 'record'"), "TextQuality", "document_id", [
            *(("Error", n > 0, _text(page, n, " ", what), "damage") for n, what in _damage(text)),
            ("Warning", quality.foreign_language(F.col("language")), _text(page, "language ", F.col("language")), "language"),
            ("Warning", quality.inconsistent_table(text), _text(page, "rows of a table differ in columns"), "table"),
        ]),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _flags(*flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(n > 0, _text(n, " ", t)) for n, t in flags)))


def _verdict(rows: DataFrame, previous: int | None, override: bool, magnitude_gates: bool) -> DataFrame:
    shift, far = quality.magnitude_shift(F.col("records"), F.lit(previous).cast("long"))
    rows = rows.withColumns({"error_rate": quality.error_rate(F.col("n_errors"), F.col("attempted")), "magnitude": shift, "magnitude_flag": far})
    sound = quality.gate(F.col("error_rate"), F.col("problems"), F.lit(False))
    return rows.withColumns({"passed_without_magnitude": sound, "passed": quality.gate(F.col("error_rate"), F.col("problems"), far, override, magnitude_gates)})


def export_report(issues: DataFrame, parsed: DataFrame, index: DataFrame, joined: DataFrame, cleaned: DataFrame, previous: int | None = None, override: bool = False) -> DataFrame:
    """One row: counts of each stage, problems, red flags and whether the run passes.

    The error rate is that of all errors among the rows attempted in both files.
    ``previous`` is the number of records of the run before; ``override``
    excuses a shift from it, nothing else.
    """
    n = lambda c: F.count_if(c)
    record = F.col("outcome") == "record"
    sides = [
        parsed.agg(n(F.col("error").isNull()).alias("parsed"), F.count(F.lit(1)).alias("_pages")),
        index.agg(n(F.col("error").isNull()).alias("index_rows"), F.count(F.lit(1)).alias("_index")),
        joined.agg(*(n(F.col("status") == s).alias(a) for s, a in (("joined", "joined"), ("missing", "missing_pages"), ("inactive", "inactive_pages")))),
        cleaned.agg(
            *(n(F.col("outcome") == o).alias(a) for o, a in (("record", "records"), ("error", "clean_errors"), ("duplicate", "duplicates"))),
            F.count_distinct(F.when(record & F.array_contains("flags", "check_date_exceeded"), F.col("document_id"))).alias("stale_docs"),
            n(record & F.col("mojibake_fixed")).alias("mojibake_pages"), F.coalesce(F.sum(F.when(record, quality.table_count(F.col("content")))), F.lit(0)).alias("n_tables"),
        ),
        quality.without_headings(cleaned.where(record), "document_id", "content").agg(F.count(F.lit(1)).alias("docs_without_headings")),
        issues.agg(n(F.col("severity") == "Error").alias("n_errors"), n(F.col("severity") != "Error").alias("n_warnings"), n(F.col("reason") == "unpaged").alias("unpaged_docs")),
    ]
    row = sides[0]
    for side in sides[1:]:
        row = row.join(side)  # single rows
    row = quality.reconcile(row.withColumn("attempted", F.col("_pages") + F.col("_index"))).drop("_pages", "_index")
    flags = _flags((F.col("unpaged_docs"), "index document(s) without pages"), (F.col("stale_docs"), "document(s) past their check date"), (F.col("docs_without_headings"), "document(s) without headings"))
    return _verdict(row.withColumn("red_flags", flags), previous, override, True)


def files_issues(parsed: DataFrame, cleaned: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """Issues of a run over analysed files.

    ``parsed`` is from :func:`structure.read_layout`, ``cleaned(blob, page,
    content, table_count)`` its pages; ``native`` holds the files' own metadata.
    A damaged page is one error.  Repeated phrases are looked for on pages
    without a detected table only.
    """
    page = _text("Page ", F.col("page"), ": ")
    damage = F.concat_ws(", ", *(F.when(n > 0, _text(n, " ", what)) for n, what in _damage(F.col("content"))))
    low = F.round("confidence", 9) < quality.LOW_CONFIDENCE
    phrases = quality.repeated_trigrams(cleaned, ["blob", "page"], "content")
    by_page = phrases.groupBy("blob", "page").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase", "n"))).alias("p"))
    said = F.array_join(F.transform("p", lambda x: F.concat(x["phrase"], F.lit(" ("), x["n"].cast("string"), F.lit("x)"))), ", ")
    frames = [
        told(parsed, "Parse", "blob", [("Error", ~F.col("ok"), F.lit("the analysis has no markdown pages"), "parse")]),
        told(cleaned, "TextQuality", "blob", [("Error", damage != "", _text(page, damage), "damage"), ("Warning", F.coalesce(low, F.lit(False)), _text(page, "low confidence"), "confidence")]),
        told(by_page, "TableFlattening", "blob", [("Warning", F.lit(True), _text(page, "repeated ", said), "phrases")]),
        told(structure.bad_tables(structure.layout_items(parsed)), "TableStructure", "blob", [("Warning", F.lit(True), _text(page, "a table without rows, columns or cells"), "table")]),
        told(structure.structure_warnings(parsed), "Analysis", "document_id", [("Warning", F.lit(True), F.col("message"), "structure")]),
        told(projections.analysis_warnings(parsed), "Analysis", "document_id", [("Warning", F.lit(True), F.col("message"), "analysis")]),
    ]
    if native is not None:
        frames.append(told(projections.native_warnings(native), "Metadata", "document_id", [("Warning", F.lit(True), F.col("message"), "metadata")]))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def files_report(issues: DataFrame, parsed: DataFrame, cleaned: DataFrame, previous: int | None = None) -> DataFrame:
    """One row, as :func:`export_report`; a shift in the number of pages is told but does not count.

    Attempted are the pages and the files that gave none.  Names that differ in
    case only are a problem.
    """
    pages_ = cleaned.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("table_count"), F.lit(0)).alias("n_tables"))
    files = parsed.agg(F.count_if("ok").alias("files_ok"), F.count_if(~F.col("ok")).alias("files_failed"))
    names = structure.name_collisions(parsed.where("ok")).agg(F.count(F.lit(1)).alias("collisions"))
    heads = quality.without_headings(cleaned, "blob", "content").agg(F.count(F.lit(1)).alias("docs_without_headings"))
    row = pages_.join(files).join(names).join(heads).join(quality.severity_counts(issues))  # single rows
    problems = F.array_compact(F.array(F.when(F.col("records") == 0, F.lit("no records")), F.when(F.col("collisions") > 0, _text(F.col("collisions"), " name(s) differ in case only"))))
    row = row.withColumns({"attempted": F.col("records") + F.col("files_failed"), "problems": problems, "red_flags": _flags((F.col("docs_without_headings"), "document(s) without headings"))})
    return _verdict(row, previous, False, False)


def last_statistics(table: store.Table, source: str) -> dict | None:
    """What the last run of a source left: ``records`` of the run, ``documents`` and ``bytes`` of the index."""
    known = table.read()
    found = None if known is None else known.where(F.col("source") == source).first()
    return None if found is None else found.asDict()


def record_statistics(table: store.Table, source: str, records: int, documents: int, size: int) -> list[str]:
    """Leave this run's statistics; a drift of the index from the last ones is told."""
    while True:
        seen = (table.state() or {}).get("version")
        known, before = table.read(), last_statistics(table, source)
        now = table.spark.createDataFrame([(source, records, documents, size)], "source string, records long, documents long, bytes long")
        drift, far = quality.index_drift(F.col("documents"), F.lit(before and before["documents"]).cast("long"))
        row = now.select(drift.alias("drift"), far.alias("far")).first()
        if table.write(now if known is None else known.where(F.col("source") != source).unionByName(now), expected=seen):
            table.prune()
            return [f"index drift {100 * row['drift']:+.1f}% ({before['documents']} -> {documents})"] if row["far"] else []
