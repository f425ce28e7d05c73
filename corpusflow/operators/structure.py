"""Structure of extracted files: outlines, layout, page confidence."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .quality import LOW_CONFIDENCE

_SPAN = "array<struct<offset:int,length:int>>"
_REGION = "array<struct<pageNumber:int>>"
LAYOUT = (
    "content string, contentFormat string, "
    f"pages array<struct<pageNumber:int,width:double,height:double,unit:string,words:array<struct<content:string,confidence:double>>,lines:array<struct<content:string,polygon:array<double>>>,selectionMarks:array<struct<state:string,confidence:double>>,spans:{_SPAN}>>, "
    f"paragraphs array<struct<role:string,content:string,spans:{_SPAN},boundingRegions:{_REGION}>>, "
    f"tables array<struct<rowCount:int,columnCount:int,cells:array<struct<rowIndex:int,columnIndex:int,content:string,kind:string>>,spans:{_SPAN},boundingRegions:{_REGION}>>, "
    f"figures array<struct<caption:struct<content:string>,spans:{_SPAN},boundingRegions:{_REGION}>>, "
    f"sections array<struct<spans:{_SPAN},elements:array<string>>>, warnings array<struct<code:string,message:string>>"
)
#: Roles of paragraphs.
HEADING_ROLES, BOILERPLATE_ROLES = ("title", "sectionHeading"), ("pageHeader", "pageFooter", "footnote", "pageNumber")

#: Seconds between asking for an analysis, and after each answer that the service is busy.
POLL, BACKOFF = 2, (2, 5, 13, 34)


def breadcrumb_paths(outline: DataFrame, doc: str = "doc") -> DataFrame:
    """``(doc, ord, page, path)``: for each resolvable entry of ``outline(doc, ord, title, level, page)`` the titles above it and its own.

    An outline is one document's; its stack of levels is kept in one group.
    """
    def walk(group: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        out = []
        for row in group.sort_values("ord").itertuples(index=False):
            while stack and stack[-1][0] >= row.level:
                stack.pop()
            stack.append((row.level, row.title))
            out.append((row.doc, row.ord, row.page, " > ".join(t for _, t in stack)))
        return pd.DataFrame(out, columns=["doc", "ord", "page", "path"])

    rows = outline.select(F.col(doc).alias("doc"), "ord", "title", "level", "page").where("page is not null")
    kinds = dict(rows.dtypes)
    return rows.groupBy("doc").applyInPandas(walk, f"doc {kinds['doc']}, ord {kinds['ord']}, page {kinds['page']}, path string")


def page_sections(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """``(doc, page, path)``: the latest entry at or before each page, of ties the last; a backward as-of join by window."""
    marks = paths.select("doc", "page", F.col("ord").cast("long").alias("ord"), "path", F.lit(False).alias("wanted"))
    asked = pages.select("doc", "page", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("wanted"))
    carried = F.last("path", ignorenulls=True).over(Window.partitionBy("doc").orderBy("page", F.col("wanted"), F.col("ord")).rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(asked).withColumn("path", carried).where("wanted").select("doc", "page", "path")


def outline_checks(outline: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per document: unresolvable, external, out-of-range entries, skipped levels, and whether none resolves."""
    before = F.lag("level").over(Window.partitionBy("doc").orderBy("ord"))
    rows = outline.withColumn("skipped", F.col("level") > F.coalesce(before, F.lit(0)) + 1).join(sizes, "doc", "left")
    inside = F.col("page").between(1, F.col("n_pages"))
    return rows.groupBy("doc").agg(
        F.count_if(F.col("page").isNull() & ~F.col("external")).alias("n_unresolvable"),
        F.count_if("external").alias("n_external"),
        F.count_if(F.col("page").isNotNull() & ~inside).alias("n_out_of_range"),
        F.count_if("skipped").alias("n_skipped"),
        (F.count_if(inside) == 0).alias("none_resolved"),
    )


def read_layout(files: DataFrame, column: str = "layout") -> DataFrame:
    """``files(blob, layout)`` with the analysis parsed; ``ok`` needs markdown content and at least one page."""
    rows = files.withColumn("a", F.from_json(column, LAYOUT)).drop(column)
    return rows.withColumn("ok", F.coalesce((F.coalesce(F.col("a.contentFormat"), F.lit("markdown")) == "markdown") & (F.size("a.pages") > 0), F.lit(False)))


def _page_of(item: Column) -> Column:
    return F.coalesce(F.get(item["boundingRegions"], F.lit(0))["pageNumber"], F.lit(0))


def layout_pages(parsed: DataFrame) -> DataFrame:
    """A row for each page: its text by spans, dimensions, lines, marks, words and their mean confidence."""
    rows = parsed.where("ok").select("blob", F.col("a.content").alias("_content"), F.explode("a.pages").alias("p"))
    words = F.coalesce(F.col("p.words"), F.array().cast("array<struct<content:string,confidence:double>>"))
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["confidence"])
    return rows.select(
        "blob",
        F.col("p.pageNumber").alias("page"),
        scalar.sliced(F.col("_content"), F.col("p.spans")).alias("content"),
        F.struct("p.width", "p.height", "p.unit").alias("dimensions"),
        F.transform("p.lines", lambda x: F.struct(x["content"].alias("content"), scalar.points(x["polygon"]).alias("polygon"))).alias("lines"),
        F.col("p.selectionMarks").alias("marks"),
        F.size(words).alias("n_words"),
        F.when(F.size(words) > 0, total / F.size(words)).alias("confidence"),
    )


def layout_items(parsed: DataFrame) -> DataFrame:
    """Headings, tables, figures and sections as one tagged list of rows ``(blob, kind, page, offset, content, n_rows, n_columns, n_cells)``."""
    def rows(kind: str, items: Column, content: Column | None = None, **more: Column) -> DataFrame:
        at = F.get(F.col("x.spans"), F.lit(0))["offset"]
        page = _page_of(F.col("x")) if kind != "section" else F.lit(0)
        sizes = [more.get(c, F.lit(None)).cast("int").alias(c) for c in ("n_rows", "n_columns", "n_cells")]
        text = F.lit(None).cast("string") if content is None else content
        return parsed.where("ok").select("blob", F.explode(items).alias("x")).select("blob", F.lit(kind).alias("kind"), page.alias("page"), at.alias("offset"), text.alias("content"), *sizes)

    headings = F.filter("a.paragraphs", lambda p: p["role"].isin(*HEADING_ROLES))
    boiler = F.filter("a.paragraphs", lambda p: p["role"].isin(*BOILERPLATE_ROLES))
    found = rows("heading", headings, F.col("x.content")).unionByName(rows("boilerplate", boiler, F.col("x.content")))
    found = found.unionByName(rows("table", F.col("a.tables"), n_rows=F.col("x.rowCount"), n_columns=F.col("x.columnCount"), n_cells=F.coalesce(F.size("x.cells"), F.lit(0))))
    return found.unionByName(rows("figure", F.col("a.figures"), F.col("x.caption.content"))).unionByName(rows("section", F.col("a.sections")))


def page_context(items: DataFrame) -> DataFrame:
    """All items of a page together; one grouping of the tagged list instead of a join for each kind."""
    own = F.struct("kind", "offset", "content", "n_rows", "n_columns", "n_cells")
    return items.groupBy("blob", "page").agg(F.array_sort(F.collect_list(own)).alias("items"), F.count_if(F.col("kind") == "table").alias("table_count"), F.count_if(F.col("kind") == "figure").alias("figure_count"))


def bad_tables(items: DataFrame) -> DataFrame:
    return items.where("kind = 'table' and (n_rows <= 0 or n_columns <= 0 or n_cells = 0)")


def structure_warnings(parsed: DataFrame, per_page: str = "0.01") -> DataFrame:
    """Per analysed file: figures without a caption, malformed tables, and what its pages cost."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    plain = size(F.filter("a.figures", lambda f: f["caption"].isNull()))
    broken = size(F.filter("a.tables", lambda t: (F.coalesce(t["rowCount"], F.lit(0)) <= 0) | (F.coalesce(t["columnCount"], F.lit(0)) <= 0) | (size(t["cells"]) == 0)))
    pages = F.size("a.pages")
    cost = (pages.cast("decimal(12,0)") * F.lit(per_page).cast("decimal(6,4)")).cast("decimal(18,2)")
    told = F.array_compact(F.array(
        F.when(plain > 0, F.concat(plain.cast("string"), F.lit(" of "), size("a.figures").cast("string"), F.lit(" figure(s) without caption"))),
        F.when(broken > 0, F.concat(broken.cast("string"), F.lit(" of "), size("a.tables").cast("string"), F.lit(" table(s) malformed"))),
        F.concat(F.lit("estimated cost $"), cost.cast("string"), F.lit(" for "), pages.cast("string"), F.lit(" page(s)")),
    ))
    return parsed.where("ok").select(F.col("blob").alias("document_id"), F.explode(told).alias("message"), F.lit("structure").alias("reason"))


def page_quality(words: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Mean confidence of each page with words, and whether it is low."""
    mean = words.groupBy(*keys).agg(F.avg(confidence).alias("confidence"), F.count(F.lit(1)).alias("n_words"))
    return mean.withColumn("low", F.round("confidence", 9) < LOW_CONFIDENCE)  # to nine places: a sum's order decides no tie


def name_collisions(files: DataFrame, name: str = "blob") -> DataFrame:
    return files.groupBy(F.upper(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def preflight(files: DataFrame, max_bytes: int = 500 << 20, max_pages: int = 2000) -> DataFrame:
    """``files(blob, length, n_pages, version, encrypted)`` with the errors and warnings that a file's outside tells."""
    errors = F.array_compact(F.array(
        F.when(F.col("length") == 0, "empty"), F.when(F.col("length") > max_bytes, "too large"), F.when(F.col("n_pages") == 0, "no pages"),
        F.when(F.col("n_pages") > max_pages, "too many pages"), F.when(F.col("encrypted"), "encrypted"),
    ))
    warnings = F.array_compact(F.array(
        F.when((F.col("length") > 0) & (F.col("length") < 10 << 10), "very small"), F.when(F.col("length").between(0.8 * max_bytes, max_bytes), "near the size limit"),
        F.when(F.col("version") < 1.4, "old version"),
    ))
    return files.withColumns({"errors": errors, "warnings": warnings, "ok": F.size(errors) == 0})


def red_flags(files: DataFrame, **flags: Column) -> DataFrame:
    """The texts of the flags that hold, in the order given."""
    return files.withColumn("red_flags", F.array_compact(F.array(*(F.when(c, F.lit(t.replace("_", " "))) for t, c in flags.items()))))


def backend(extract: Callable[[str, bytes], str]) -> object:
    """A file extractor ``(blob, bytes) -> analysis JSON`` as a column function: ``(layout, error)``, of which one is null."""
    @F.pandas_udf("layout string, error string")
    def run(blob: pd.Series, content: pd.Series) -> pd.DataFrame:
        def one(name: str, data: bytes) -> tuple[str | None, str | None]:
            try:
                return extract(name, data), None
            except Exception as error:  # one file's failure is its own row's
                return None, f"{type(error).__name__}: {error}"

        return pd.DataFrame([one(b, c) for b, c in zip(blob, content, strict=True)], columns=["layout", "error"])

    return run


class LayoutClient(Protocol):
    """A service that analyses files; a failed call's exception has its ``status``."""

    def submit(self, blob: str, content: bytes) -> object: ...

    def poll(self, job: object) -> str | None:
        """The analysis, or none while it is not ready."""


def service(client: LayoutClient, wait: Callable[[float], None] = time.sleep) -> Callable[[str, bytes], str]:
    """An extractor over a service: a file is submitted once, as that is paid for; only asking is tried again."""
    def extract(blob: str, content: bytes) -> str:
        job, busy = client.submit(blob, content), 0
        while True:
            try:
                found = client.poll(job)
            except Exception as error:
                if getattr(error, "status", None) != 429 or busy == len(BACKOFF):
                    raise
                wait(BACKOFF[busy])
                busy += 1
                continue
            if found is not None:
                return found
            wait(POLL)

    return extract
