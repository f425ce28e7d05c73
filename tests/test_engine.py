"""Sources, joins, diff, store and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunk, diff, embed, evaluate, pages, retrieve, store, structure, validate
from corpusflow.plans.pipelines import GateError, IndexTables, ask, index_export, index_files, restore_index
from corpusflow.session import Config
from corpusflow.sources import csv_export, files
from corpusflow.streaming import incremental

PAGES = "DOCUMENT_ID,TITLE,QUICK_CODE,FOLDER_MINI_FULL_PATH,LAST_MODIFIED_DATETIME,PAGE_INDEX,PAGE_CONTENT,RELATIVE_PATH,LANGUAGE\n"
INDEX = "DOCUMENT_ID,DOCUMENT_TYPE_NAME,SUMMARY,VERSION,REVISION,CHECK_DATE,ATTENTION_REQUIRED_FLAGS,ACTIVE\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def export(tmp_path, docs, stamp="20240101120000"):
    pages_csv = PAGES + "".join(f'{d},Title {d},QC,Folder,{stamp},{p},"Content of {d}, page {p}.\nMore about {w} here.",rel,nl-NL\n' for d, p, w in docs)
    index_csv = INDEX + "".join(f'{d},Protocol,A summary,7,0,20240101,[],true\n' for d in sorted({d for d, _, _ in docs}))
    return write(tmp_path / "pages.csv", pages_csv), write(tmp_path / "index.csv", index_csv)


def test_header_contract(spark, tmp_path):
    for text, word in [("a;b;c\n", "delimiter"), ("A,A,B\n", "duplicate"), ("DOCUMENT_ID,TITLE\n", "missing")]:
        with pytest.raises(csv_export.HeaderError, match=word):
            csv_export.read_header(spark, write(tmp_path / "x.csv", text), csv_export.PAGE_COLUMNS)
    assert csv_export.read_header(spark, write(tmp_path / "y.csv", PAGES.lower()), csv_export.PAGE_COLUMNS)[0] == "DOCUMENT_ID"


def test_rows_good_bad_good(spark, tmp_path):
    rows = "doc1,T,Q,F,20240101120000,0,\"a\nb\",r,nl\n,T,Q,F,20240101120000,0,x,r,nl\n\" doc3 \",T,Q,F,20240101120000,1,y,r,nl\ndoc4,T,Q,F,20240101120000,one,y,r,nl\n"
    found = csv_export.read_pages(spark, write(tmp_path / "p.csv", PAGES + rows)).orderBy("row_no").collect()
    assert [(r["row_no"], r["document_id"], r["error"] is None) for r in found] == [(2, "doc1", True), (3, "", False), (4, "doc3", True), (5, "doc4", False)]
    assert found[0]["page_content"] == "a\nb"
    index = csv_export.read_index(spark, write(tmp_path / "i.csv", INDEX + "d,P,S,7,,,[],maybe\ne,P,S,7,,,[],\n")).orderBy("row_no").collect()
    assert [(r["error"] is None, r["active"]) for r in index] == [(False, None), (True, True)]


def test_join_batch(spark):
    rows = spark.createDataFrame([(1, "MATCHED", 0), (2, "inactive", 0), (3, "inactive", 1), (4, "notfound", 0), (5, "NotFound", 1)], "row_no long, document_id string, page_index int")
    index = spark.createDataFrame([(1, "matched", True), (2, "Matched", False), (3, "inactive", False), (4, "orphan", True)], "row_no long, document_id string, active boolean")
    found = pages.join_pages(rows, index).orderBy("row_no").collect()
    assert [(r["status"], r["reported"]) for r in found] == [("joined", False), ("inactive", True), ("inactive", False), ("missing", True), ("missing", False)]
    assert [r["document_id"] for r in pages.index_without_pages(rows, index).collect()] == ["orphan"]
    assert found[0]["duplicates"] == 1


def test_diff_rules(spark):
    source = spark.createDataFrame([("A", 5, True), ("b", 5, True), ("c", 1, True), ("d", 1, False), ("e", 1, False)], "document_id string, m int, active boolean").withColumn("modified", F.timestamp_seconds("m"))
    known = spark.createDataFrame([("B", 3), ("C", 3), ("D", 3), ("X", 3)], "key string, m int").select("key", F.timestamp_seconds("m").alias("indexed"))
    assert sorted(map(tuple, diff.classify(source, known).collect())) == [("A", "new", False), ("B", "updated", True), ("C", "skipped", False), ("D", "inactive", True), ("E", "inactive", False), ("X", "removed", True)]
    assert {r["key"]: r["status"] for r in diff.classify(source, known, force=True).collect()}["C"] == "updated"
    assert {r["key"]: r["status"] for r in diff.classify(source, known, truncate=True).collect()}["B"] == "skipped"


def test_table_versions(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    assert table.state() is None and table.read() is None
    for k in range(5):
        assert table.write(spark.range(k))
    seen = table.state()["version"]
    assert table.read().count() == 4 and table.statistics()[0] == 4
    assert table.write(spark.range(9), expected="other") is False and table.read().count() == 4
    assert table.write(spark.range(9), expected=seen) is True and table.read().count() == 9
    assert table.prune() == 3 and table.read().count() == 9
    # A writer that dies over its pointer, and one that comes second.
    number = table.state()["number"]
    (tmp_path / "t" / f"current-{number + 1:012d}.json").write_text('{"vers')
    assert table.read().count() == 9 and table.write(spark.range(3)) and table.read().count() == 3
    for done in (True, False):
        expected = False if done else table.state()["version"]
        other = store.Table(spark, str(tmp_path / "t"))
        stale = iter([other._names("current-")])
        other._names = lambda prefix, stale=stale, other=other: next(stale, None) or store.Table._names(other, prefix)
        assert table.write(spark.range(5)) and other.write(spark.range(7), expected=expected) is done
        assert table.read().count() == (7 if done else 5)
    # Only what is not there is no state.
    (tmp_path / "t" / f"current-{table.state()['number'] + 1:012d}.json").mkdir()
    with pytest.raises(Exception, match="directory|Directory"):
        table.state()


def test_embedding_tries_again_where_it_may_help():
    assert all(map(embed.transient, (Failed(429), Failed(503), TimeoutError(), ConnectionResetError())))
    assert not any(map(embed.transient, (Failed(400), Failed(None), ValueError())))


def test_index_run_is_incremental_and_restores(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "index"))
    embedder = embed.hashing_embedder(16)
    calls = []
    counted = lambda texts: calls.append(len(texts)) or embedder(texts)
    docs = [("doc1", 0, "apples"), ("doc1", 1, "pears"), ("doc2", 0, "plums")]
    first = index_export(spark, *export(tmp_path, docs), tables, embedder, 16)
    assert (first["docs_new"], first["chunks_written"], first["problems"]) == (2, 3, [])
    again = index_export(spark, *export(tmp_path, docs), tables, embedder, 16)
    assert (again["docs_skipped"], again["chunks_written"]) == (2, 0) and tables.chunks.read().count() == 3
    fewer = export(tmp_path, [("doc1", 0, "cherries")], "20240102120000")
    with pytest.raises(GateError, match="magnitude"):  # a third of the last run's records
        index_export(spark, *fewer, tables, embedder, 16)
    third = index_export(spark, *fewer, tables, embedder, 16, override=True)
    assert third["red_flags"][-1] == "index drift -66.7% (3 -> 1)" and third["magnitude_flag"] and third["passed"]
    assert tables.cache.read().count() == 1 and not list((tmp_path / "index" / "handed").iterdir())
    told = spark.read.parquet(str(tmp_path / "index" / "archive" / "embedding"))
    assert told.where("n_chunks = 3").count() == 1 and told.count() == 3
    assert (third["docs_updated"], third["docs_removed"]) == (1, 1)
    rows = tables.chunks.read().collect()
    assert len(rows) == 1 and "cherries" in rows[0]["content"] and len(rows[0]["vector"]) == 16
    before = sorted(map(str, rows))
    assert restore_index(tables) == 0 and sorted(map(str, tables.chunks.read().select(*rows[0].asDict()).collect())) == before
    told = ask(tables.chunks.read(), "What about cherries?", embedder)
    assert "cherries" in told["answer"] and told["citations"] == [{"document_id": "doc1", "page": 0}]
    with pytest.raises(ValueError):
        ask(tables.chunks.read(), " ", embedder)
    assert counted(["x"]) and calls == [1]


def test_run_report(spark, tmp_path):
    rows = [("good", 0, "Text of a page", "nl-NL"), ("good", 1, "# Head\nlost � character", "nl"), ("good", 1, "again", "nl"), ("none", 0, "x", "en-US"), ("idle", 0, "x", ""), ("good", 2, " ", "de-DE")]
    pages_path = write(tmp_path / "p.csv", PAGES + "".join(f'{d},T,Q,F,20240101120000,{p},"{t}",r,{lang}\n' for d, p, t, lang in rows) + ",T,Q,F,20240101120000,0,x,r,nl\n")
    index_path = write(tmp_path / "i.csv", INDEX + 'good,P,S,7,0,20240101,"[""check_date_exceeded""]",true\ngood,P,S,7,0,20240101,[],true\nidle,P,S,7,0,20240101,[],false\nunpaged,P,S,7,0,20240101,[],true\n')
    tables = IndexTables(spark, str(tmp_path / "index"))
    with pytest.raises(GateError) as stopped:
        index_export(spark, pages_path, index_path, tables, embed.hashing_embedder(8), 8, environment="Development", run_id="r1")
    told = stopped.value.report
    assert [told[k] for k in ("parsed", "index_rows", "joined", "missing_pages", "inactive_pages", "records", "duplicates", "attempted")] == [6, 4, 4, 1, 1, 3, 1, 11]
    assert (told["n_errors"], told["n_warnings"], told["stale_docs"], told["unpaged_docs"], told["problems"]) == (3, 6, 1, 1, [])
    assert told["red_flags"] == ["1 index document(s) without pages", "1 document(s) past their check date"]
    issues = spark.read.parquet(str(tmp_path / "index" / "archive" / "extraction"))
    found = sorted((r["stage"], r["severity"], r["document_id"], r["reason"]) for r in issues.collect())
    assert found == [
        ("Clean", "Warning", "good", "blank"), ("Clean", "Warning", "good", "duplicate"), ("Join", "Error", "none", "missing"), ("Join", "Warning", "good", "duplicate"), ("Join", "Warning", "idle", "inactive"),
        ("Join", "Warning", "unpaged", "unpaged"), ("Parse:Pages", "Error", "", "parse"), ("TextQuality", "Error", "good", "damage"), ("TextQuality", "Warning", "good", "language"),
    ]
    assert tables.chunks.read() is None and tables.statistics.read() is None


def test_file_issues(spark):
    said = "the same three words " * 10
    doc = {
        "content": said, "pages": [{"pageNumber": n, "spans": [{"offset": 0, "length": len(said)}]} for n in (1, 2)], "warnings": [{"code": "C", "message": "m"}],
        "tables": [{"rowCount": 1, "columnCount": 1, "cells": [], "boundingRegions": [{"pageNumber": 2}]}], "figures": [{"boundingRegions": []}, {"caption": {"content": "c"}}],
    }
    parsed = structure.read_layout(spark.createDataFrame([("a.pdf", json.dumps(doc)), ("A.PDF", json.dumps(doc | {"content": "�", "tables": []})), ("bad", "{}")], "blob string, layout string"))
    tables = structure.page_context(structure.layout_items(parsed)).select("blob", "page", "table_count")
    cleaned = structure.layout_pages(parsed).join(tables, ["blob", "page"], "left").fillna(0, ["table_count"])
    issues = validate.files_issues(parsed, cleaned)
    found = sorted((r["document_id"], r["severity"], r["reason"], r["message"]) for r in issues.where("reason <> 'analysis'").collect())
    assert found == [
        ("A.PDF", "Error", "damage", "Page 1: 1 replacement character(s), 1 control or unassigned character(s)"), ("A.PDF", "Error", "damage", "Page 2: 1 replacement character(s), 1 control or unassigned character(s)"),
        ("A.PDF", "Warning", "structure", "1 of 2 figure(s) without caption"), ("A.PDF", "Warning", "structure", "estimated cost $0.02 for 2 page(s)"),
        ("a.pdf", "Warning", "phrases", "Page 1: repeated same three words (10x), the same three (10x), three words the (9x)"),
        ("a.pdf", "Warning", "structure", "1 of 1 table(s) malformed"), ("a.pdf", "Warning", "structure", "1 of 2 figure(s) without caption"), ("a.pdf", "Warning", "structure", "estimated cost $0.02 for 2 page(s)"),
        ("a.pdf", "Warning", "table", "Page 2: a table without rows, columns or cells"), ("bad", "Error", "parse", "the analysis has no markdown pages"),
    ]
    told = validate.files_report(issues, parsed, cleaned, previous=100).first()
    assert (told["problems"], told["attempted"], told["magnitude_flag"], told["passed"], told["n_errors"]) == (["1 name(s) differ in case only"], 5, True, False, 3)


class Failed(Exception):
    def __init__(self, status, retry_after=None):
        self.status, self.retry_after = status, retry_after


def test_layout_service(spark):
    class Client:
        def __init__(self, answers):
            self.answers, self.submitted = iter(answers), 0

        def submit(self, blob, content):
            self.submitted += 1
            return blob

        def poll(self, job):
            answer = next(self.answers)
            if isinstance(answer, Exception):
                raise answer
            return answer

    waits = []
    client = Client([None, Failed(429), Failed(429), None, "done"])
    assert structure.service(client, waits.append)("a", b"x") == "done" and client.submitted == 1 and waits == [2, 2, 5, 2]
    for failures in ([Failed(500)], [Failed(429)] * 5):
        with pytest.raises(Failed):
            structure.service(Client(failures), waits.append)("a", b"x")

    def extract(blob, content):
        return content.decode() if blob != "bad" else 1 / 0

    rows = spark.createDataFrame([("a", bytearray(b"{}")), ("bad", bytearray(b"{}"))], "blob string, content binary")
    found = rows.select("blob", structure.backend(extract)("blob", "content").alias("r")).select("blob", "r.*").orderBy("blob").collect()
    assert [(r["layout"], r["error"]) for r in found] == [("{}", None), (None, "ZeroDivisionError: division by zero")]


def test_references_and_ranking(spark):
    rows = [json.dumps(r) for r in ({"id": "i", "document_id": "d", "page_number": 3, "title": "T", "content": "c", "page_count": 9, "created_at": "2024-01-02T03:04:05Z"}, {"content": "only", "page_number": None}, {"content": " "}, {"id": "x"})]
    found = retrieve.map_references(spark.createDataFrame([(r,) for r in [*rows, None]], "source_data string")).orderBy("id").collect()
    assert [(r["id"], r["document_id"], r["page_number"], r["chunk_index"], r["title"], r["page_count"]) for r in found] == [("", "", 0, 0, None, None), ("i", "d", 3, 0, "T", 9)]
    assert found[1]["created_at"].hour == 3 and found[0]["created_at"] is None
    told = spark.createDataFrame([("T", "S", "c"), ("T", " ", "c"), ("T", None, "c"), (None, "S", "c")], "t string, s string, c string").select(retrieve.context_text(F.col("t"), F.col("s"), F.col("c")).alias("x"))
    assert [r["x"] for r in told.collect()] == ["[T\nS]\nc", "[T]\nc", "[T]\nc", "c"]
    hits = spark.createDataFrame([("a", "x"), ("b", "xxx"), ("c", "xx")], "id string, content string")
    best = retrieve.rerank(hits, "q", lambda q, texts: [float(len(t)) for t in texts], "id", "content", 2)
    assert [(r["id"], r["rank"]) for r in best.orderBy("rank").collect()] == [("b", 1), ("c", 2)]


def test_gate_stops_a_bad_run(spark, tmp_path):
    pages_path, index_path = export(tmp_path, [("doc1", 0, "x")])
    with open(pages_path, "a", encoding="utf-8") as f:
        f.write(",T,Q,F,20240101120000,0,x,r,nl\n")
    with pytest.raises(GateError):
        index_export(spark, pages_path, index_path, IndexTables(spark, str(tmp_path / "i")), embed.hashing_embedder(8), 8)


def test_files_run_diffs_first(spark, tmp_path):
    tables = IndexTables(spark, str(tmp_path / "files"))
    embedder = embed.hashing_embedder(8)

    def layout(text):
        return json.dumps({"content": text, "pages": [{"pageNumber": 1, "spans": [{"offset": 0, "length": len(text)}]}], "paragraphs": [{"role": "title", "content": "Head", "boundingRegions": [{"pageNumber": 1}]}], "tables": [{"rowCount": 1, "columnCount": 1, "boundingRegions": [{"pageNumber": 1}]}]})

    def state(rows):
        frame = spark.createDataFrame(rows, "blob string, day int, text string")
        listing = frame.select("blob", F.timestamp_seconds(F.col("day") * 86400).alias("modified"))
        return listing, spark.createDataFrame([(b, layout(t) if t else "{}") for b, _, t in rows], "blob string, layout string")

    first = index_files(spark, *state([("my-a.pdf", 1, "Text of a."), ("b.pdf", 1, "Text of b.")]), tables, embedder, 8)
    assert (first["docs_new"], first["chunks_written"]) == (2, 2)
    row = tables.chunks.read().where("document_id = 'my-a.pdf'").first()
    assert (row["content"], row["table_count"], row["has_table"], len(row["vector"])) == ("my a\n\nHead\n\nText of a.", 1, True, 8)
    with pytest.raises(GateError):
        index_files(spark, *state([("my-a.pdf", 2, "Other text."), ("b.pdf", 2, "")]), tables, embedder, 8)
    second = index_files(spark, *state([("my-a.pdf", 2, "Other text."), ("b.pdf", 2, "")]), tables, embedder, 8, environment="Development")
    assert second["n_errors"] == 1 and len(list((tmp_path / "files" / "reports").iterdir())) == 1
    assert (second["docs_updated"], second["files_failed"], second["chunks_written"]) == (2, 1, 1)
    kept = {r["document_id"]: r["content"] for r in tables.chunks.read().collect()}
    assert "Other text." in kept["my-a.pdf"] and "Text of b." in kept["b.pdf"]  # a failed file keeps its chunks
    idle = index_files(spark, *state([("my-a.pdf", 2, "Other text."), ("b.pdf", 1, "x")]), tables, embedder, 8)
    assert (idle["docs_skipped"], idle["chunks_written"]) == (2, 0)
    assert restore_index(tables) == 0 and tables.cache.read().count() == 2


def test_embedding_retries_and_dimensions(spark):
    rows = spark.createDataFrame([("h1", "a"), ("h2", "b")], "content_hash string, embedding_text string")

    def flaky(texts, state={"n": 0}):
        state["n"] += 1
        if state["n"] < 3:
            raise TimeoutError
        return [[1.0] * 4 for _ in texts]

    found = embed.embed_texts(rows.coalesce(1), flaky, 5, wait=lambda s: None).collect()
    assert len(found) == 2 and all(r["bad_dims"] for r in found) and sum(r["retries"] for r in found) == 2


def test_neighbours_and_context(spark):
    schema = "id string, document_id string, page_number int, chunk_index int, content string"
    chunks = spark.createDataFrame([("a4", "a", 4, 0, "four"), ("a5", "a", 5, 0, "five"), ("a6", "a", 6, 0, "six"), ("a9", "a", 9, 0, "nine"), ("b0", "b", 0, 0, " ")], schema)
    hits = chunks.where("id = 'a5'").withColumn("rank", F.lit(1))
    beside = retrieve.neighbours(hits, chunks)
    assert sorted(r["id"] for r in beside.collect()) == ["a4", "a6"]
    assert [r["content"] for r in retrieve.context(hits, beside).orderBy("place").collect()] == ["four", "five", "six"]
    long = spark.createDataFrame([(k, k, 0, 0, "x" * 7500) for k in "abc"], schema).withColumn("rank", F.ascii("id") - 96)
    assert retrieve.context(long, chunks.limit(0)).count() == 2


def test_outline(spark):
    outline = spark.createDataFrame([("d", 0, "Chapter 1", 0, 1, False), ("d", 1, "1.1 Intro", 1, 2, False)], "doc string, ord int, title string, level int, page int, external boolean")
    asked = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc string, page int")
    found = structure.page_sections(asked, structure.breadcrumb_paths(outline)).orderBy("page").collect()
    assert [r["path"] for r in found] == ["Chapter 1", "Chapter 1 > 1.1 Intro", "Chapter 1 > 1.1 Intro"]
    twins = spark.createDataFrame([("d", 0, "Part A", 0, 1, False), ("d", 1, "Part B", 0, 1, False)], outline.schema)
    assert structure.page_sections(asked.where("page = 1"), structure.breadcrumb_paths(twins)).first()["path"] == "Part B"


def test_layout(spark):
    doc = {
        "content": "Title\n\nText <table></table>", "pages": [{"pageNumber": 1, "words": [{"content": "w", "confidence": 0.4}, {"content": "v", "confidence": 0.5}], "spans": [{"offset": 0, "length": 5}]}, {"pageNumber": 2, "words": [], "spans": []}],
        "paragraphs": [{"role": "title", "content": "Title", "spans": [{"offset": 0, "length": 5}], "boundingRegions": [{"pageNumber": 1}]}, {"role": "pageFooter", "content": "f"}],
        "tables": [{"rowCount": 0, "columnCount": 0, "cells": [], "boundingRegions": [{"pageNumber": 2}]}], "figures": [{"boundingRegions": []}], "sections": [{"spans": [{"offset": 0, "length": 3}]}],
    }
    parsed = structure.read_layout(spark.createDataFrame([("f.pdf", json.dumps(doc)), ("g.pdf", "{}"), ("h.pdf", None)], "blob string, layout string"))
    assert [r["ok"] for r in parsed.orderBy("blob").collect()] == [True, False, False]
    pages_ = structure.layout_pages(parsed).orderBy("page").collect()
    assert pages_[0]["content"] == "Title" and abs(pages_[0]["confidence"] - 0.45) < 1e-9 and pages_[1]["confidence"] is None
    items = structure.layout_items(parsed)
    assert sorted((r["kind"], r["page"]) for r in items.collect()) == [("boilerplate", 0), ("figure", 0), ("heading", 1), ("section", 0), ("table", 2)]
    assert structure.bad_tables(items).count() == 1 and structure.page_context(items).where("page = 2").first()["table_count"] == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", "x"), (3, None, None)], "k long, a string, e string")
    assert [(r["k"], round(r["f1"], 4)) for r in evaluate.token_f1(rows, "k", "a", "e").orderBy("k").collect()] == [(1, 0.6667), (2, 0.0), (3, 0.0)]
    able = rows.withColumn("able", F.col("k") == 2)
    assert sorted(tuple(r) for r in evaluate.token_f1(able, "k", "a", "e", "able").collect()) == [(1, -1.0), (2, 0.0), (3, -1.0)]
    waits, answers = [], [Failed(429), Failed(429, 1.5), {"x": 1.0}]

    def busy(*_):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert evaluate._ask(busy, ("q",), waits.append) == {"x": 1.0} and waits == [4, 1.5]
    asked = spark.createDataFrame([("q", "a", "c"), ("bad", "a", "c")], "query string, answer string, context string")

    def judge(q, a, c):
        return dict.fromkeys(evaluate.SCORES, 4.0) if q != "bad" else 1 / 0

    assert [(r["succeeded"], r["groundedness"]) for r in evaluate.judged(asked, judge).collect()] == [(True, 4.0), (False, 0.0)]


def test_files_and_links(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.PDF").write_bytes(b"x")
    (tmp_path / "in" / "b.txt").write_bytes(b"y")
    assert files.list_files(spark, str(tmp_path / "in")).count() == 1
    links = files.read_links(spark, write(tmp_path / "l.txt", " /richtlijnen/a \n/richtlijnen/a\n/other\n/richtlijnen/b\n"))
    assert links.count() == 2 and files.links_to_fetch(links, links.where("link like '%a'")).count() == 1
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int") is None
    golden = files.read_golden(spark, write(tmp_path / "g.json", '[{"Query": " "}, {"Query": "q"}]'))
    assert [r["AnswerableFromCorpus"] for r in golden.collect()] == [True]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    rows = spark.createDataFrame([("d", k, f"T{k}", f"Sentence {k}. " * 200) for k in range(3)], "document_id string, page_index int, title string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    table = store.Table(spark, str(tmp_path / "t"))
    stream = incremental.document_stream(spark, str(tmp_path / "in"), "document_id string, page_index int, title string, content string")
    for name in ("c1", "c2"):
        incremental.index_stream(stream, table, str(tmp_path / name)).awaitTermination()
    docs = rows.select(F.col("document_id").alias("source_id"), F.col("page_index").alias("ordinal"), "content")
    assert table.read().count() == chunk.chunk_documents(docs).count()


def test_configuration():
    with pytest.raises(ValueError, match="search_endpoint, index_name"):
        Config.from_mapping({})
    names = [k for k in Config.__dataclass_fields__ if k not in ("dimensions", "embedding_model", "environment", "context_chars", "top_k")]
    assert len(names) == 11 and Config.from_mapping(dict.fromkeys(names, "x") | {"dimensions": "64"}).dimensions == 64
