"""MinHash and suffix-array dedup against plain Python."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import near_components, removed_bytes
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import kernels, substrings
from corpusflow.llm.common import flat_bytes
from corpusflow.llm.components import connected_components
from corpusflow.llm.minhash import band_keys, near_duplicates, one_permutation
from corpusflow.llm.queries import QUERIES
from corpusflow.llm.substrings import cut_repeats
from corpusflow.llm.suffix import common_prefixes, suffix_array


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, odd, odd_rows, size):
    found = near_duplicates(odd, size=size).collect()
    expected = near_components([(r[0], r[1]) for r in odd_rows], size)
    assert sorted((r[0], r[1], r[2], r[3]) for r in found if r[0] is not None) == sorted(expected)
    assert sorted(r["kept"] for r in found if r[0] is None) == [True, True]


def test_near_duplicates_of_a_large_group_of_near_misses(spark):
    """One base, many edits: links between leaves of a star must not be lost."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for n in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"x{n}_{at}"
        rows.append((n, " ".join(words)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(near_components(rows, 4))


def test_near_duplicates_of_short_documents_that_share_a_band(spark):
    """Few shingles fill all bins with copies: what shares a band is still decided on the sets."""
    rows = []
    for n in range(4000):
        words = [f"w{n}_{k}" for k in range(8)]
        rows += [(2 * n, " ".join(words[:7])), (2 * n + 1, " ".join(words))]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    texts = pa.array([text for _, text in rows])
    sets = kernels.shingle_sets(*kernels.word_hashes(*flat_bytes(texts)), 4)
    keys = band_keys(one_permutation(sets, 512), 64)
    banded = [2 * n for n in range(4000) if (keys[2 * n] == keys[2 * n + 1]).any()]
    assert len(banded) > 3000 and all(found[d] == found[d + 1] == d for d in banded)


def test_near_duplicates_of_other_texts_under_one_id(spark):
    """A chain through ids that hold several texts: no link is lost, in whatever order rows come."""
    base = {name: [f"{name}{k}" for k in range(40)] for name in "abcd"}
    near = {name: " ".join([*words[:39], "z"]) for name, words in base.items()}
    text = {name: " ".join(words) for name, words in base.items()}
    rows = [(1, near["a"]), (2, near["b"]), (5, text["a"]), (5, text["b"]), (5, text["c"]), (9, near["c"]), (9, text["d"]), (12, near["d"]), (13, "alone here"), (5, None), (9, text["d"]), (1 << 62, text["d"])]
    rows += [((1 << 63) - 1, "far"), ((1 << 63) - 1, "away"), (-(1 << 63), "away")]
    for order in (rows, rows[::-1]):
        found = near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), size=4)
        assert sorted(tuple(r) for r in found.collect()) == sorted(near_components(rows, 4))


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).collect() == []


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for n in (6, 60, 2000):
        pool = rng.integers(0, 1 << 63, n * 2, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = one_permutation([a, b], 4096)
        assert abs((x == y).mean() - true) < 0.25 if n == 6 else 0.05


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {200: 199}


def test_cut_repeats_match_brute_force(spark, odd, odd_rows):
    found = cut_repeats(odd).collect()
    rows = sorted({(r[0], r[1]) for r in odd_rows if r[0] is not None})
    expected = removed_bytes(rows, 100)
    assert len(found) == len(odd_rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_cut_repeats_of_a_passage_with_other_surroundings(spark, hot_rows, monkeypatch):
    """One passage in most documents, between texts of their own: also where its keys are split."""
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (100, hot_rows))
    rng = random.Random(21)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edge = words(260), words(97)
    rows = [(k, words(rng.randint(0, 90)) + (passage if k % 3 else edge) + words(rng.randint(0, 90))) for k in range(90)]
    rows += [(100 + k, passage[: 99 + k] + edge * 3) for k in range(4)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == removed_bytes(rows, 100)


def test_cut_repeats_when_hashes_collide(spark, monkeypatch):
    """With hashes of three bits nothing but equal bytes goes."""
    rng = random.Random(22)
    rows = [(k, "".join(rng.choice("ab") for _ in range(300))) for k in range(12)]
    rows += [(20 + k, rows[k][1][50:230] + rows[k + 1][1]) for k in range(6)]
    whole = kernels.range_hash
    monkeypatch.setattr(substrings.kernels, "range_hash", lambda *args: whole(*args) & np.uint64(7 << 32))
    held = []
    for part in (rows[:9], rows[9:]):
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in part]), pa.array([t for _, t in part])], names=["doc_id", "text"])
        held += substrings._anchor_rows(100)(iter([batch]))
    covered = {(d, b) for batch in held for _, kind, d, loc in zip(*(c.to_pylist() for c in batch.columns), strict=True) if kind == substrings.COVERED for b in range(loc >> 32, loc & 0xFFFFFFFF)}
    assert not covered - {(d, b) for d, text in rows for k in range(len(text) - 99) if any(text[k : k + 100] in other for e, other in rows if e < d) for b in range(k, k + 100)}


def test_suffix_dedup_query_by_hand(spark):
    """Every contract column of the query on a whole table."""
    data = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op2_suffix_array"](spark, data).collect()}
    assert found == removed_bytes(rows, 100)


def test_cut_repeats_of_other_texts_under_one_id(spark):
    rows = [(1, "x" * 300), (1, "y" * 300), (2, None)]
    found = sorted((r["doc_id"], r["n_removed"]) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [f[0] for f in found] == [1, 1, 2] and sorted(f[1] for f in found) == [0, 0, 299]


def test_cut_repeats_of_nothing(empty):
    assert cut_repeats(empty).collect() == []


def test_memory_of_a_shard():
    """A key may fill a shard with 20,000 pieces of 134 bytes, on each core of an executor: what a symbol takes is bounded."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    passage = rng.choice(letters, 66).tobytes()
    pieces = [rng.choice(letters, 34).tobytes() + passage + rng.choice(letters, 34).tobytes() for _ in range(2000)]
    tracemalloc.start()
    try:
        substrings.repeated_windows(pieces, np.arange(2000), np.zeros(2000, np.int64), 100)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 85 * (2000 * 135)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_suffix_array_is_sorted(symbols):
    order = suffix_array(np.array(symbols, np.int64))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda k: symbols[k:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=12))
def test_common_prefixes(pieces):
    text = "\0".join(pieces) + "\0"
    symbols = np.array([ord(c) and ord(c) - 96 for c in text])
    ends = np.array([m.start() for m in re.finditer("\0", text)])
    left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    order = suffix_array(symbols)
    found = common_prefixes(symbols, order, left)
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = text[a : a + left[a]], text[b : b + left[b]]
        assert found[b] == next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
