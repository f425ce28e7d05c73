"""Text cleaning steps; each maps a text column to a text column."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalar import trimmed

#: Damaged sequences in the order in which they are repaired, and ligatures.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€“", "–"), ("â€”", "—"), ("Ã«", "ë"), ("Ã©", "é"), ("Ã¯", "ï"), ("Ã¼", "ü")]
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
INVISIBLE = "​‌‍﻿­"
#: Fixed value: control characters that extraction leaves behind; those beyond ASCII stay.
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: What Windows-1252 reads in the bytes from 128 to 159, less those that it leaves open; these are read as control characters.
_SHOWN = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_WINDOWS = r"^[\x00-\x7F\x81\x8D\x8F\x90\x9D\xA0-\xFF" + "".join(_SHOWN.values()) + r"]*+\z"
#: Text bytes and rows that a Python worker holds as Python strings together; a longer text is a slice of its own.
_SLICE_BYTES, _SLICE_ROWS = 1 << 20, 1024

_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def _mapped(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of every text, slice by slice; null stays null."""
    out, begin, held = [], 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > begin and (held + n > _SLICE_BYTES or k - begin == _SLICE_ROWS):
            out.append(pa.array([t if t is None else f(t) for t in texts.slice(begin, k - begin).to_pylist()], pa.string()))
            begin, held = k, 0
        held += n
    return pa.concat_arrays([*out, pa.array([t if t is None else f(t) for t in texts.slice(begin).to_pylist()], pa.string())])


def _in_python(f: Callable[[str], str], needs: Callable[[Column], Column] | None = None) -> Callable[[Column | str], Column]:
    """A column function of ``f``, which leaves texts without ``needs`` as they are; those do not go to Python."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return _mapped(texts, f)

    def column(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return run(text) if needs is None else F.coalesce(run(F.when(needs(text), text)), text)

    return column


def _entity(match: re.Match) -> str:
    name = match[1]
    if name[0] != "#":
        code = name2codepoint.get(name, 39 if name == "apos" else None)
    else:
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return match[0] if code is None or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _decoded(text: str) -> str:
    return _ENTITY.sub(_entity, text)


def _composed(text: str) -> str:
    return unicodedata.normalize("NFC", text)


decode_entities = _in_python(_decoded, lambda text: F.contains(text, F.lit("&")))
#: Characters below the first combining mark are composed.
nfc = _in_python(_composed, lambda text: text.rlike(r"[\x{300}-\x{10FFFF}]"))


def repair_roundtrip(text: Column) -> Column:
    """A text that was UTF-8 read as Windows-1252, read right; others as they are."""
    damaged = (F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("â"))) & text.rlike(_WINDOWS)
    plain = F.translate(F.when(damaged, text), "".join(_SHOWN.values()), "".join(map(chr, _SHOWN)))
    fixed = F.try_validate_utf8(F.encode(plain, "ISO-8859-1").cast("string"))
    return F.when(~F.contains(fixed, F.lit("�")), fixed).otherwise(text)


def _all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def line_ends(text: Column) -> Column:
    return _all(text, [("\r\n", "\n"), ("\r", "\n")])


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[a-zA-Z][^<>]*>", "")


def repair_table(text: Column) -> Column:
    return _all(text, MOJIBAKE)


def has_mojibake(text: Column) -> Column:
    """Whether any repair of the table applies; a repair makes no new damage, so one look suffices."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p, _ in MOJIBAKE))


def drop_logo(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^[ \t]*(contoso|CONTOSO)[ \t]*$\n?", "")


def drop_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")


def collapse_newlines(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_page(text: Column) -> Column:
    """The cleaner of exported pages: tags go before entities are decoded."""
    decoded = decode_entities(strip_tags(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))))
    return collapse_newlines(drop_images(drop_logo(repair_table(line_ends(decoded)))))


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROLS, "")


def drop_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def expand_ligatures(text: Column) -> Column:
    return _all(text, LIGATURES)


def plain_spaces(text: Column) -> Column:
    return F.translate(text, " ", " ")


def join_hyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\p{Ll})-\n(?=\p{Ll})", "")


def tidy_space(text: Column) -> Column:
    return collapse_newlines(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|\z)", ""), r"[ \t]{2,}", " "))


def clean_extracted(text: Column) -> Column:
    """The cleaner of extracted files; composing is the only Python."""
    text = repair_roundtrip(line_ends(F.coalesce(text, F.lit(""))))
    text = nfc(plain_spaces(expand_ligatures(drop_invisible(drop_controls(text)))))
    return tidy_space(join_hyphenated(text))


def drop_decoration(text: Column) -> Column:
    """Whole-line comments of page headers, footers, numbers and breaks; underlined titles become headings.

    No pattern goes back over what it has read, so a line takes time in proportion to its length.
    """
    text = F.regexp_replace(text, r'(?md)^[ \t]*+<!-- (?:PageHeader|PageFooter|PageNumber)="[^\n]*" -->[ \t]*+$\n?', "")
    text = F.regexp_replace(text, r"(?md)^[ \t]*+<!-- PageBreak -->[ \t]*+$\n?", "")
    text = F.regexp_replace(text, r"(?md)^(?=[^\S\n]*+\S)([^\n]++)\n=++[ \t]*+$", "# $1")
    return F.regexp_replace(text, r"^[\r\n]++|(?<![\r\n])[\r\n]++\z", "")


class _Body(HTMLParser):
    skip, void = {"header", "footer", "nav", "script", "style"}, {"br", "img", "input", "meta", "link", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.void:
            marks = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
            self.stack.append((tag, tag in self.skip or "breadcrumb" in marks or "cookie" in marks))

    def handle_endtag(self, tag):
        while self.stack and any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if not any(skipped for _, skipped in self.stack):
            self.out.append(data)


def _body(page: str) -> str:
    parser = _Body()
    parser.feed(page)
    return re.sub(r"\s+", " ", " ".join(parser.out)).strip()


#: A web page without what surrounds its content: header, footer, nav, breadcrumbs, cookie notices, scripts.
page_body = _in_python(_body)
