"""Byte-level BPE vocabularies from public tokenizer files, as executor-side encoders.

The files lie where ``public_tokenizers`` is installed, on every executor; their
paths are parameters.  An encoder is built once for a Python worker.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from . import kernels

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _printed_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def json_encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a ``tokenizers`` byte-level BPE file; added tokens are found in texts as that library does.

    The file's merges must be in id order (a rank is an id), which is checked.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    byte_of = _printed_bytes()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    vocabulary = model["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"merges of {path} are not in id order")
    return tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Longest run of white space that tiktoken's pattern engine is given; it runs out of stack on some hundred thousand.
SPACE_RUN = 10_000
_LONG_SPACE = re.compile(r"\s{64,}")


@lru_cache(maxsize=2)
def json_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def json_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text by a ``tokenizers`` file, from tiktoken where it can and else from that library itself; they are the same."""
    if any(len(run) > SPACE_RUN for run in _LONG_SPACE.findall(text)):
        return np.array(json_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return json_encoder(path).encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_APOSTROPHE = ord("'")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point in the pattern's terms."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for run in regex.findall(pattern, every):
            first, last = ord(run[0]), ord(run[-1])
            kinds[first : last + 1] = np.where((np.arange(first, last + 1) >= 0xD800) & (np.arange(first, last + 1) < 0xE000), kinds[first : last + 1], kind)
    return kinds


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a match of the pattern begins; ``offsets`` are the bounds of the texts in ``points``.

    The pattern has no gaps, so starts say everything: a run of letters, of
    numbers or of others takes one space before it; a run of white space keeps
    all but its last character together if something follows; an apostrophe
    that begins a match takes the letters of a contraction with it.
    """
    n = len(points)
    kind = _classes()[points]
    starts = np.zeros(n + 1, bool)
    if not n:
        return starts[:n]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = np.zeros(n, bool)
    first[begins] = True
    last = np.zeros(n, bool)
    last[np.append(begins[1:], n) - 1] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    tail = space & ~last  # the last of a run of white space that something follows
    tail[:-1] &= ~space[1:]
    starts[:n] = change
    starts[:n] |= tail
    taken = np.zeros(n, bool)  # begins one earlier, at its space
    taken[1:] = (tail & (points == 0x20))[:-1]
    starts[:n] &= ~taken
    for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
        size = len(letters) + 1
        at = np.flatnonzero((points[: n - size + 1] == _APOSTROPHE) & starts[: n - size + 1]) if n >= size else np.zeros(0, int)
        for k, letter in enumerate(letters, 1):
            at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
        starts[at + 1] = False
        ends = at + size
        ends = ends[ends < n]
        starts[ends] |= ~space[ends]
    return starts[:n]


def _word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = kernels.powers(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(kernels.mix(points.astype(np.uint64) + np.uint64(0x632BE59B)) * up[: len(points)], out=sums[1:])
    return kernels.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Pre-tokens of ``texts``: bounds of each text's words, index into the distinct words, their hashes, and how to read them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *map(len, texts)])
    starts = np.flatnonzero(pretoken_starts(points, offsets))
    ends = np.append(starts[1:], len(points))
    hashes, first, index = np.unique(_word_hashes(points, starts, ends), return_index=True, return_inverse=True)
    return np.searchsorted(starts, offsets), index, hashes, [points, starts[first], ends[first]]


def read_word(source: list, k: int) -> str:
    points, starts, ends = source
    return points[starts[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass")


def ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs ``values[begins[p] : begins[p] + sizes[p]]`` of all ``picks`` in a row."""
    lengths = sizes[picks]
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return values[:0]
    at = np.repeat(begins[picks] - (total - lengths), lengths)
    return values[at + np.arange(total[-1])]
