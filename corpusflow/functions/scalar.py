"""Scalar functions as column expressions; lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MAX_EMBEDDING_CHARS = 24_000
INACTIVE = ("ingetrokken", "vervangen", "inactive", "withdrawn", "replaced")


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def trimmed(c: Column) -> Column:
    """Without white space (by Unicode) at both ends; null gives an empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def safe_key(name: Column, index: Column) -> Column:
    """URL-safe base64 of ``name::index``."""
    plain = F.base64(F.encode(F.concat(name, F.lit("::"), index.cast("string")), "UTF-8"))
    return F.translate(F.regexp_replace(plain, r"\s", ""), "+/", "-_")


def content_hash(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def embedding_text(summary: Column, content: Column) -> Column:
    return F.when(blank(summary), content).otherwise(F.concat(summary, F.lit("\n\n"), content))


def truncated(text: Column, most: int = MAX_EMBEDDING_CHARS) -> tuple[Column, Column]:
    """The first ``most`` characters, and whether that cut anything."""
    return F.substring(text, 1, most), F.length(text) > most


def token_estimate(text: Column) -> Column:
    """Pieces between single spaces that are not empty."""
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def starts_clean(text: Column) -> Column:
    return text.rlike(r"^[\p{Lu}\p{Nd}]")


def ends_clean(text: Column) -> Column:
    return text.rlike(r"""[.!?:)"']\z""")


def exact_timestamp(text: Column, pattern: str = "yyyyMMddHHmmss") -> Column:
    """Null where the text is not exactly of the pattern (digits only)."""
    return F.when(text.rlike(rf"^[0-9]{{{len(pattern)}}}$"), F.try_to_timestamp(text, F.lit(pattern)))


def optional_date(text: Column) -> tuple[Column, Column]:
    """A date of the form yyyyMMdd, null if blank; and whether it is bad."""
    value = F.when(~blank(text), exact_timestamp(trimmed(text), "yyyyMMdd"))
    return value, ~blank(text) & value.isNull()


def pdf_date(text: Column) -> Column:
    """``D:yyyyMMddHHmmss`` and whatever follows, as UTC; else null."""
    return exact_timestamp(F.substring(F.regexp_replace(text, "^D:", ""), 1, 14))


def lenient_date(text: Column) -> Column:
    return text.try_cast("timestamp")


def version_text(version: Column, revision: Column) -> Column:
    number = F.when(revision.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(revision).try_cast("int"))
    return F.when(blank(version), "").when(number.isNotNull(), F.concat_ws(".", trimmed(version), number.cast("string"))).otherwise(trimmed(version))


def active_flag(text: Column) -> tuple[Column, Column]:
    """Blank means true; only true and false are allowed. The value, and whether the text is bad."""
    low = F.lower(trimmed(text))
    return F.when(blank(text), True).when(low.isin("true", "false"), low == "true"), ~blank(text) & ~low.isin("true", "false")


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))


def string_array(text: Column) -> tuple[Column, Column]:
    """A JSON array of strings without blank entries, trimmed; blank text is no entries. The value, and whether the text is bad."""
    plain = text.rlike(r'^\s*\[\s*(("([^"\\]|\\.)*"|null)\s*(,\s*("([^"\\]|\\.)*"|null)\s*)*)?\]\s*$')
    parsed = F.from_json(F.when(plain, text), "array<string>")
    kept = F.transform(F.filter(parsed, lambda x: x.isNotNull() & x.rlike(r"(?U)\S")), trimmed)
    return F.when(blank(text), F.array().cast("array<string>")).otherwise(kept), ~blank(text) & ~F.coalesce(plain, F.lit(False))


def title_or_stem(title: Column, blob: Column) -> Column:
    stem = F.replace(F.regexp_extract(blob, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("-"), F.lit(" "))
    return F.when(blank(title), stem).otherwise(title)


def is_active(status: Column) -> Column:
    """Fails open: only the fixed words mean inactive."""
    return status.isNull() | ~F.lower(trimmed(status)).isin(*INACTIVE)


def assembled(title: Column, heading: Column, chunk: Column) -> Column:
    return F.concat_ws("\n\n", F.when(~blank(title), title), F.when(~blank(heading), heading), chunk)


def preview(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def points(flat: Column) -> Column:
    """``[x1, y1, ...]`` as points; an odd tail is dropped."""
    pairs = F.floor(F.size(flat) / 2)
    places = F.when(pairs > 0, F.sequence(F.lit(0), (pairs - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(F.get(flat, 2 * k).alias("x"), F.get(flat, 2 * k + 1).alias("y")))


def sliced(text: Column, spans: Column) -> Column:
    """The parts of a text that ``spans(offset, length)`` name, in order of offset."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.substring(text, s["offset"] + 1, s["length"])), "")


def astral_count(text: Column) -> Column:
    """Characters beyond the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int") - F.length(text)


def guids(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def citation_match(expected: Column, cited: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(-1.0)).otherwise(F.size(F.array_intersect(expected, cited)) / F.size(expected))


def signed_percent(value: Column) -> Column:
    return F.format_string("%+.1f%%", value)
