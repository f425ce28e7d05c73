"""Chunking strategies, chunk assembly and chunk statistics.

A strategy is a function from a text to chunk texts, plain Python and testable
without Spark; :func:`chunk_documents` runs one over a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import assembled, ends_clean, safe_key, starts_clean, token_estimate

Strategy = Callable[[str], list[str]]

_ENDERS = (". ", "! ", "? ")
_BAR_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE_ROW = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
_SENTENCE = re.compile(r".*?(?:[.!?]+(?=\s|$)\s*|$)", re.DOTALL)


def _last_sentence_end(text: str, begin: int, stop: int) -> int:
    """The largest place of a sentence ender and a space within ``text[begin:stop]``, else -1."""
    return max(text.rfind(e, begin, stop) for e in _ENDERS)


def sentence_window(text: str, most: int = 1500, overlap: int = 150) -> list[str]:
    """Windows of ``most`` characters that end at the last sentence, else word, of their second half.

    The next window starts with the last sentence that fits into ``overlap``
    characters before the split, else ``overlap`` characters before it.
    """
    out, start = [], 0
    while start + most < len(text):
        end, half = start + most, start + most // 2 + 1
        cut = _last_sentence_end(text, half, end + 2)
        if cut < 0:
            cut = text.rfind(" ", half, end + 1)
        split = end if cut < 0 else cut + 1
        out.append(text[start:split])
        if overlap > 0 and split - overlap > start:
            cut = _last_sentence_end(text, split - overlap, split)
            start = cut + 2 if cut >= 0 else max(start + 1, split - overlap)
        else:
            start = split
    out.append(text[start:])
    return [c for c in map(str.strip, out) if c]


def _table_pieces(rows: list[str], most: int) -> list[str]:
    """A table whole if it fits, else groups of its rows under its header."""
    whole = "\n".join(rows)
    if len(whole) <= most:
        return [whole]
    head = 2 if len(rows) > 1 and _RULE_ROW.match(rows[1]) else 1
    header = "\n".join(rows[:head])
    out, group = [], []
    for row in rows[head:]:
        if group and len("\n".join([header, *group, row])) > most:
            out.append("\n".join([header, *group]))
            group = []
        group.append(row)
    return [*out, "\n".join([header, *group])] if group else out


def table_window(text: str, most: int = 1500, overlap: int = 150) -> list[str]:
    """Tables are kept together or cut between rows, with their header repeated; prose goes by sentences."""
    runs: list[tuple[bool, list[str]]] = []
    for line in text.split("\n"):
        is_row = bool(_BAR_ROW.match(line))
        if runs and runs[-1][0] == is_row:
            runs[-1][1].append(line)
        else:
            runs.append((is_row, [line]))
    merged: list[tuple[bool, list[str]]] = []
    for is_row, lines in runs:
        is_row = is_row and len(lines) > 1  # a lone row is prose
        if merged and not is_row and not merged[-1][0]:
            merged[-1][1].extend(lines)
        else:
            merged.append((is_row, list(lines)))
    out = []
    for is_row, lines in merged:
        out += _table_pieces(lines, most) if is_row else sentence_window("\n".join(lines), most, overlap)
    return [c for c in out if c.strip()]


def _overlap_tail(text: str, overlap: int) -> str:
    """What a chunk hands on: its last ``overlap`` characters after their first sentence end."""
    if overlap <= 0 or len(text) <= overlap:
        return ""
    tail = text[-overlap:]
    at = min((k for k in (tail.find(e[0]) for e in _ENDERS) if k >= 0), default=-1)
    rest = tail[at + 1 :].strip() if at >= 0 else ""
    return rest or tail.strip()


def _packed_sentences(text: str, most: int) -> list[str]:
    out, now = [], ""
    for sentence in filter(None, map(str.strip, _SENTENCE.findall(text))):
        if now and len(now) + 1 + len(sentence) > most:
            out.append(now)
            now = sentence
        else:
            now = f"{now} {sentence}" if now else sentence
    return [*out, now] if now else out


def paragraph_window(text: str, target: int = 1000, most: int = 1500, least: int = 200, overlap: int = 150) -> list[str]:
    """Paragraphs are gathered until ``target`` and never beyond ``most``; a short last chunk joins the one before."""
    pieces = []
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        pieces += [paragraph] if len(paragraph) <= most else _packed_sentences(paragraph, most)
    out, now = [], ""
    for piece in pieces:
        if now and (len(now) + len(piece) + 2 > most or len(now) >= target):
            out.append(now)
            now = _overlap_tail(now, overlap)
        now = f"{now}\n\n{piece}" if now else piece
    if now.strip():
        out.append(now)
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = [f"{out[-2]}\n\n{out[-1]}"]
    return out


STRATEGIES: dict[str, Strategy] = {"sentence": sentence_window, "table": table_window, "paragraph": paragraph_window}


def chunk_documents(docs: DataFrame, strategy: str | Strategy = "sentence", id_column: str = "source_id", ordinal: str = "ordinal", content: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, ordinal, chunk_index, chunk)`` of every document page, and its columns ``carry``; blank contents have no chunks."""
    cut = STRATEGIES[strategy] if isinstance(strategy, str) else strategy

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, number, chunks = [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    for n, chunk in enumerate(cut(text) if text and text.strip() else []):
                        owner.append(k)
                        number.append(n)
                        chunks.append(chunk)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()), pa.array(chunks, pa.string()), *(c.take(take) for c in part.columns[3:])], names=[id_column, ordinal, "chunk_index", "chunk", *carry])

    kinds = dict(docs.dtypes)
    schema = f"{id_column} {kinds[id_column]}, {ordinal} {kinds[ordinal]}, chunk_index int, chunk string" + "".join(f", {c} {kinds[c]}" for c in carry)
    return docs.select(id_column, ordinal, content, *carry).mapInArrow(rows, schema)


def assemble(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their key, title and heading prepended, and the document's metadata."""
    rows = chunks.join(documents.select("source_id", "ordinal", "metadata"), ["source_id", "ordinal"])
    heading = F.col("metadata")["heading"]
    return rows.select(
        safe_key(F.concat_ws("::", "source_id", F.col("ordinal").cast("string")), F.col("chunk_index")).alias("id"),
        F.col("source_id").alias("document_id"),
        F.col("ordinal").alias("page_number"),
        "chunk_index",
        heading.alias("heading"),
        assembled(F.col("metadata")["title"], heading, F.col("chunk")).alias("content"),
        "metadata",
    )


def chunk_statistics(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: counts, duplicates, lengths with the 95th of them, size bands, coherence, headings.

    The 95th is the value at place ``min(floor(0.95 n), n - 1)`` of the sorted
    lengths, read off a histogram of lengths: no task holds all chunks.
    """
    size = F.length(content)
    heading = F.col("heading") if "heading" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.select(F.sha2(content, 256).alias("h"), size.alias("n"), (starts_clean(F.col(content)) & ends_clean(F.col(content))).alias("coherent"), heading.isNotNull().alias("headed"))
    histogram = rows.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    up_to = F.sum("k").over(Window.orderBy("n"))
    total = histogram.agg(F.sum("k").alias("total"))
    place = F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1)
    p95 = histogram.withColumn("up_to", up_to).join(F.broadcast(total)).where(F.col("up_to") > place).agg(F.min("n").alias("p95"))  # one row
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_duplicates"))
    told = rows.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.avg("n").alias("avg_chars"),
        F.count_if(F.col("n") < 100).alias("under_100"), F.count_if((F.col("n") >= 100) & (F.col("n") < 500)).alias("under_500"),
        F.count_if((F.col("n") >= 500) & (F.col("n") < 1500)).alias("under_1500"), F.count_if(F.col("n") >= 1500).alias("from_1500"),
        F.count_if("coherent").alias("n_coherent"), F.count_if("headed").alias("n_headed"),
    )
    return told.join(F.broadcast(copies)).join(F.broadcast(p95))  # each side is one row


def chunk_flags(chunks: DataFrame, content: str = "content", most: int = 1024, least: int = 20) -> DataFrame:
    tokens = token_estimate(F.col(content))
    return chunks.withColumns({"tokens": tokens, "is_empty": tokens == 0, "is_oversized": tokens > most, "is_undersized": tokens < least})
