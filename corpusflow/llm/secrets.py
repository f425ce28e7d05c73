"""Secret scans: fixed patterns, and a probabilistic automaton of credential formats.

The automaton is inferred from labelled credentials (those that the fixed
patterns find, a bounded sample by hash): their prefix tree over character
classes, in which states whose futures are statistically alike are merged (the
frequencies of ending and of each symbol differ by less than a Hoeffding bound,
recursively).  Every token that could be a credential, whether a fixed pattern
holds it or not, is scored by its likelihood per symbol; what score is enough, credentials held out of a fit say.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import text_slices

#: In the order of the contract; the automaton's kind comes last.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the automaton looks at: long runs of credential characters, each as a whole, without dots around it.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
LEAST_LENGTH = 16

#: Credentials that the automaton is fitted on at most.
SAMPLE = 4000
#: Confidence of the merge test, and symbols of a credential that the sample holds (the fit is bounded, the scoring is not).
ALPHA, DEPTH = 0.05, 128
#: Least mean log-likelihood per symbol of a reported token; held-out credentials raise it to what all but ``MISSED`` of them reach.
LEAST, MISSED, SLACK = -2.2, 0.005, 0.1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, in code points; matches too short are dropped after matching."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def symbols(token: str) -> str:
    """Classes of all characters: digit, hexadecimal letter, other small letter, capital, mark."""
    return "".join("d" if c.isdigit() else "h" if c in "abcdef" else "l" if c.islower() else "u" if c.isupper() else "m" for c in token)


class Automaton:
    """A stochastic automaton from state merging over a prefix tree of words."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for word in words:
            at = 0
            for c in word:
                self.visits[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                at = self.next[at][c]
            self.visits[at] += 1
            if len(word) < DEPTH:  # what the sample cut short has no known end
                self.ends[at] += 1
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) >= math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), self.visits[a], self.count[b].get(c, 0), self.visits[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_states(self) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            seen = {(p, c) for p, c in blue}
            blue += [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red and (r, c) not in seen]
        self.states = len(red)

    def likelihood(self, word: str) -> float:
        """Mean log-likelihood per symbol; transitions never seen count for one in a thousand."""
        at, total = 0, 0.0
        for c in word:
            n = self.visits[at] if at is not None else 0
            seen = self.count[at].get(c, 0) if at is not None else 0
            total += math.log((seen + 1e-3) / (n + 1e-3)) if seen else math.log(1e-3)
            at = self.next[at].get(c) if at is not None and seen else None
        return total / max(1, len(word))


def labelled_credentials(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """Symbols of at most ``most`` distinct credentials of the fixed patterns, the smallest by hash; at most ``most * DEPTH`` bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = {}
                for text in part.column(0).to_pylist():
                    for start, end, kind in base_spans(text or ""):
                        value = text[start:end]
                        value = _ASSIGN.match(value)[2] if kind == "assign" else value
                        found[hashlib.sha256(value.encode()).digest()] = symbols(value[:DEPTH])
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.string())], names=["mark", "symbols"])

    found = docs.select("text").mapInArrow(rows, "mark binary, symbols string").groupBy("mark").agg(F.first("symbols").alias("symbols"))
    return [r["symbols"] for r in found.orderBy("mark").limit(most).collect()]


def calibrated(words: list[str], least: float = LEAST) -> float:
    """The score that held-out credentials reach: every second word fits an automaton, the others are scored by it."""
    if len(words) < 8:
        return least
    model = Automaton(sorted(words[::2]))
    held = sorted(map(model.likelihood, words[1::2]))
    return max(least, held[int(MISSED * len(held))] - SLACK)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the tokens that are scored: with a digit and a letter, at least ``LEAST_LENGTH`` long without dots at their ends."""
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        start = m.start() + len(token) - len(token.lstrip("."))
        end = m.end() - len(token) + len(token.rstrip("."))
        token = text[start:end]
        if len(token) >= LEAST_LENGTH and any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token):
            yield start, end


_RESULT = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])


def _finder(docs: DataFrame, sample: int, least: float):
    """A function from a text to its base and added spans; the automaton is fitted on credentials of ``docs``."""
    words = [w for w in labelled_credentials(docs, sample) if len(w) >= 12]
    model = Automaton(sorted(words)) if words else None
    least = calibrated(words, least)

    def spans(text: str | None) -> tuple[list, list]:
        text = text or ""
        added = [(a, b, "format") for a, b in candidates(text) if model.likelihood(symbols(text[a:b])) >= least] if model else []
        return base_spans(text), added

    return spans


def find_secrets(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST, prefix: str = "_s_") -> DataFrame:
    """``docs`` with ``_s_base`` and ``_s_added``: arrays of ``(start, end, kind)`` in code points, in order.

    ``_s_base`` holds the fixed patterns' spans, ``_s_added`` tokens with a digit
    and a letter that the automaton finds likely over all their symbols, within
    those or not; a token is a whole run, however long.  Null texts
    count as empty.  Repeated rows and null ids are no special case; all rows
    come back with all columns.
    """
    finder, at = _finder(docs, sample, least), docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(prefix + "base", ArrayType(_RESULT)), StructField(prefix + "added", ArrayType(_RESULT))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = zip(*map(finder, part.column(at).to_pylist()), strict=True)
                columns = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans] for spans in x], kind) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return docs.mapInArrow(rows, schema)


def redact(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """``docs`` with every span that :func:`find_secrets` reports replaced by ``[kind]`` in ``text``; other columns stay."""
    finder, names, at = _finder(docs, sample, least), docs.columns, docs.columns.index("text")

    def told(text: str | None) -> str | None:
        base, added = finder(text)
        parts, end = [], 0
        for a, b, kind in sorted([*base, *added], key=lambda s: (s[0], -s[1])):
            if b > end:
                if a >= end:
                    parts += [text[end:a], f"[{kind}]"]
                end = b
        return "".join([*parts, text[end:]]) if parts else text

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = pa.array(map(told, part.column(at).to_pylist()), part.column(at).type)
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], names=names)

    return docs.mapInArrow(rows, docs.schema)
