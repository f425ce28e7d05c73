"""Scalar and cleaning functions on literal cases."""

from datetime import datetime

from pyspark.sql import functions as F

from corpusflow.functions import cleaning, scalar
from corpusflow.operators import quality


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_page_cleaner(spark):
    cases = {
        "Intro text\ncontoso\nMore text": "Intro text\nMore text",
        "Welcome to Contoso, our organisation.": "Welcome to Contoso, our organisation.",
        "Before ![alt](path/to/image.png) After": "Before  After",
        "Line one\n\n\n\n\nLine two": "Line one\n\nLine two",
        "Tom &amp; Jerry &lt;3": "Tom & Jerry <3",
        "<p>a</p>&lt;b&gt;": "a<b>",
    }
    for text, wanted in cases.items():
        assert one(spark, cleaning.clean_page(F.col("t")), t=text) == wanted


def test_extract_cleaner(spark):
    cases = {
        "GeÃ¯nformeerde beslissing": "Geïnformeerde beslissing", "x Ã¯ Ã« Ã© Ã¼ y": "x ï ë é ü y", "vâme": "vâme", "GeÃ¯nformeerd → volgende stap": "GeÃ¯nformeerd → volgende stap",
        "samen-\nwerking A-\nb": "samenwerking A-\nb", "oﬃce x  y \nz": "office x y\nz", "a​b\x07": "ab", "é": "é", None: "",
    }
    for text, wanted in cases.items():
        assert one(spark, cleaning.clean_extracted(F.col("t")), t=text) == wanted


def test_scalars(spark):
    assert one(spark, scalar.trimmed(F.col("t")), t="  x\t\n") == "x"
    assert one(spark, scalar.exact_timestamp(F.col("t")), t="20240101120000") == datetime(2024, 1, 1, 12)
    assert one(spark, scalar.exact_timestamp(F.col("t")), t="2024010112000x") is None
    assert one(spark, scalar.pdf_date(F.col("t")), t="D:20240101120000+02'00'") == datetime(2024, 1, 1, 12)
    assert one(spark, scalar.version_text(F.col("v"), F.col("r")), v="7", r="0") == "7.0"
    assert one(spark, scalar.version_text(F.col("v"), F.col("r")), v="7", r=" ") == "7"
    assert one(spark, scalar.active_flag(F.col("t"))[0], t=" ") is True and one(spark, scalar.active_flag(F.col("t"))[1], t="yes") is True
    assert one(spark, scalar.string_array(F.col("t"))[0], t='["a ", null, ""]') == ["a"]
    assert one(spark, scalar.string_array(F.col("t"))[1], t='["a", 1]') is True
    assert one(spark, scalar.title_or_stem(F.col("a"), F.col("b")), a=None, b="x/my-file.v2.pdf") == "my file.v2"
    assert one(spark, scalar.is_active(F.col("t")), t="Vervangen") is False and one(spark, scalar.is_active(F.col("t")), t=None) is True
    assert one(spark, scalar.points(F.array(*(F.lit(float(k)) for k in range(5)))), t="") == [(0.0, 1.0), (2.0, 3.0)]
    assert one(spark, scalar.points(F.array(F.lit(1.0))), t="") == []
    assert one(spark, scalar.guids(F.col("t")), t="a 0F8FAD5B-d9cb-469f-a165-70867728950e 0f8fad5b-D9CB-469f-a165-70867728950e") == ["0f8fad5b-d9cb-469f-a165-70867728950e"]
    assert one(spark, scalar.astral_count(F.col("t")), t="a😀b") == 1
    assert len(one(spark, scalar.safe_key(F.col("t"), F.lit(1)), t="x" * 200).split()) == 1


def test_quality_checks(spark):
    assert one(spark, quality.replacement_chars(F.col("t")), t="a�b�") == 2
    assert one(spark, quality.bad_chars(F.col("t")), t="a\x07\n\t") == 1
    assert one(spark, quality.inconsistent_table(F.col("t")), t="| a | b |\n| c |\n") is True
    assert one(spark, quality.inconsistent_table(F.col("t")), t="| a | b |\n| c | d |") is False
    assert one(spark, quality.unbalanced_tables(F.col("t")), t="<TABLE border=1></table ><table>") is True
    assert one(spark, quality.index_drift(F.lit(110), F.lit(100))[1], t="") is False and one(spark, quality.index_drift(F.lit(50), F.lit(100))[1], t="") is True
    assert one(spark, quality.index_drift(F.lit(50), F.lit(0))[1], t="") is False
    assert one(spark, quality.error_rate(F.lit(0), F.lit(0)), t="") == 100.0


def test_trigrams(spark):
    text = "one two three " * 3 + " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, text), (2, "one two three " * 4)], "p long, text string")
    assert [(r["p"], r["phrase"], r["n"]) for r in quality.repeated_trigrams(rows, ["p"]).collect()] == [(1, "one two three", 3)]
