"""Queries over documents against their SQL on texts that the small tables do not have."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow import catalog
from corpusflow.functions import cleaning


@pytest.fixture(scope="module")
def against_sql(spark, tmp_path_factory):
    """Compares a query with its SQL on documents of the texts given, null ids and lengths among them."""

    def run(name: str, texts: list[str | None]) -> None:
        d = str(tmp_path_factory.mktemp(name))
        rows = [(k, t, None if t is None else len(t)) for k, t in enumerate(texts + texts)] + [(None, t, None if t is None else len(t)) for t in texts]
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
        told = con.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in told.description]
        assert sorted(map(repr, told.fetchall())) == sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, d).select(columns).collect())

    return run


def test_preflight_of_documents_without_text(against_sql):
    against_sql("file_preflight", ["some text", "", "", None, "x" * 10240, "x" * 10239, ""])


def test_decoration_around_texts_of_any_kind(against_sql):
    lookalikes = ["a\n===\nb", "===\nb", '<!-- PageHeader="y" -->', "x\n <!-- PageBreak --> \ny", "1 = 3 "]
    against_sql("page_decoration", ["some text", "", None, "\n\nends\n\n", "ends\r", "\r\n", " ", *lookalikes])


def test_decoration_of_long_lines(spark):
    """One line of two million characters and no title below it; the same titles as before."""
    rows = [("a long line " * 170_000, "a long line " * 170_000), (" \t Title \n== \nx\n \n===\n", " \t Title \nx\n \n===".replace(" \t", "#  \t", 1)), ("\n\r\nx\r\n", "x"), ("\n\n", "")]
    told = spark.createDataFrame(rows, "dirty string, clean string").select(cleaning.drop_decoration(F.col("dirty")).alias("got"), "clean").collect()
    assert all(r.got == r.clean for r in told)


def test_repairs_without_python(spark, against_sql):
    """The repair is built in, so no worker holds a batch of texts, whatever the number of rows; and texts of any kind come back."""
    against_sql("repair_mojibake_roundtrip", ["some text", "", None, "â Ã é", "� x", "日本 \x81\x9d"])
    frame = spark.createDataFrame([("cafÃ© â€™",), ("â€\x9d",), ("Ã 日",), ("Ã\x80",), ("ï¿½Ã©",), ("â",), (None,)], "t string").select(cleaning.repair_roundtrip(F.col("t")).alias("t"))
    assert [r.t for r in frame.collect()] == ["café ’", "”", "Ã 日", "Ã\x80", "ï¿½Ã©", "â", None]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_python_holds_a_slice_of_texts(spark):
    """Of 80 MB of texts a worker has some MB as Python strings at a time; texts that need nothing do not reach it."""
    texts = pa.array([None, "", "é" * 4_000_000, *["é" * 20_000] * 1_800, *["x"] * 3_000])
    tracemalloc.start()
    got = cleaning._mapped(texts, cleaning._composed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.slice(3).to_pylist() == ["é" * 20_000] * 1_800 + ["x"] * 3_000 and got.slice(0, 2).to_pylist() == [None, ""] and len(got[2].as_py()) == 4_000_000
    assert peak < 30e6
    assert cleaning._mapped(texts.slice(0, 0), cleaning._composed).to_pylist() == []

    refuse = cleaning._in_python(lambda t: t[99_999], lambda t: F.contains(t, F.lit("&")))
    assert [r[0] for r in spark.createDataFrame([("a",), ("",), (None,)], "t string").select(refuse("t")).collect()] == ["a", "", None]


def test_flagship_sends_only_texts_with_entities_to_python(spark, tmp_path):
    spark.createDataFrame([(1, "a &amp; b", "en"), (2, "c", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalog.flagship(spark, str(tmp_path))
    assert "CASE WHEN Contains" in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in frame.collect()] == [("en", 2, 1, 5, 3.0)]
