"""URLs, chat, nearest neighbours, the pipeline."""

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import chat, urls, vectors
from corpusflow.llm.queries import LISTED_LABELS, ORACLE_SQL, QUERIES, URL_RULES

DATA = "/root/testdata/sf0.001"
RULES = "rule_host string, rule_path string, verdict string"


def test_urls_by_definition(spark):
    pages = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/de/"), (3, "https://notexample.net/en/"), (4, None), (5, "no scheme"), (6, "http://x.example.com/de/1"),
        (7, "http://example.com"), (8, "http://a.org/fr/://b"), (9, "x://y://z/p#f"), (10, "http://listed.com/a.html?x=1"), (10, "http://listed.com/a.html?x=1"), (11, "http://www.listed.com/a/"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'clash' as host", "1 as key")
    listed = spark.createDataFrame([("https://listed.com/a",), (None,), ("bad",)], "url string")
    found = urls.judge_urls(frame, spark.createDataFrame(URL_RULES, RULES), listed).collect()
    assert len(found) == len(pages)
    got = {r["page_id"]: tuple(r)[1:] for r in found}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"), 3: ("notexample.net", "/en/", "net/", "block"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("x.example.com", "/de/1", "example.com/de/", "block"), 7: ("example.com", "", None, "allow"), 8: ("a.org", "/fr/://b", "org/fr/", "allow"),
        9: ("y:", "//z/p", None, "allow"), 10: ("listed.com", "/a.html", None, "block"), 11: ("www.listed.com", "/a/", None, "block"),
    }
    empty = urls.judge_urls(frame.limit(0), spark.createDataFrame([], RULES), listed.limit(0))
    assert empty.collect() == []


def test_bloom_filter_loses_nothing_even_when_full(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    bloom = urls.bloom_filter(keys, "key", 16)
    assert bloom.count() <= 16 and urls.possible(keys, "key", bloom, 16).count() == 5000
    sparse = urls.bloom_filter(keys.limit(50), "key", 1 << 12)
    others = spark.range(5000).selectExpr("concat('o', id) as key")
    assert urls.possible(others, "key", sparse, 1 << 12).count() < 50


def test_urls_run_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urls.judge_urls(pages, spark.sql("select 'net' as rule_host, '/' as rule_path, 'block' as verdict"), pages)._jdf.queryExecution().toString()
    assert not re.search("PythonUDF|MapInArrow|MapInPandas|ArrowEval", plan)


def test_chat_recovers_roles_and_segments_agree(spark):
    rng = np.random.default_rng(1)
    rows = []
    for conv in range(40):
        for turn in range(8):
            role = ("user", "assistant")[turn % 2]
            body = "What is " + "x" * int(rng.integers(3, 9)) + "?" if role == "user" else "\n".join("It is " + "y " * int(rng.integers(30, 90)) for _ in range(2))
            rows.append((conv, turn, role, body))
    rows += [(50, 0, "user", None), (50, 1, "assistant", ""), (None, 0, "user", "x"), (51, None, "user", "x"), (52, 0, "user", "same"), (52, 0, "user", "same")]
    lines = chat.transcript_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = lines.collect()
    assert sorted(r["n"] for r in told if r["conv_id"] == 3) == list(range(sum(r["conv_id"] == 3 for r in told)))
    lines = chat.parse(lines)
    model = chat.fit(lines.where("conv_id < 20"))
    whole, cut = (sorted(map(tuple, chat.recover_roles(lines, model, s).collect())) for s in (512, 3))
    assert [w[3:] for w in whole] == [c[3:] for c in cut] and len(whole) == len(told)
    right = {(r["conv_id"], r["n"]): r["role"] for r in told}
    held = [w for w in whole if 20 <= w[0] < 40]
    assert sum(right[w[0], w[1]] == w[3] for w in held) >= 0.95 * len(held)
    turns = chat.render(chat.recover_roles(lines, model)).where("conv_id = 3").orderBy("turn").collect()
    assert turns[0]["rendered"].startswith("<|user|>\nWhat is") and turns[0]["rendered"].endswith("<|end|>\n")


def test_chat_of_nothing(spark):
    lines = chat.transcript_lines(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    lines = chat.parse(lines)
    assert chat.recover_roles(lines, chat.fit(lines)).collect() == [] and chat.render(chat.recover_roles(lines, chat.fit(lines))).collect() == []


def test_chat_of_odd_lines(spark):
    """Nulls, empty and long lines, repeated conversations, clashing columns."""
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "User: " + "x" * 100_000), (None, 0, "Bot: hello"), (None, 1, "what?"), (2, 0, "Assistant: yes")]
    lines = chat.parse(spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, n long, line string, segment int, before string"))
    found = chat.recover_roles(lines, chat.fit(lines)).collect()
    assert Counter((r["conv_id"], r["n"]) for r in found) == Counter((c, n) for c, n, _ in rows) and {r["role"] for r in found} <= set(chat.ROLES)
    assert next(r["body"] for r in found if r["conv_id"] == 1 and r["n"] == 2) == "x" * 100_000
    turns = chat.render(chat.recover_roles(lines, chat.fit(lines))).collect()
    assert all(t["rendered"].startswith(f"<|{t['role']}|>\n") for t in turns)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(9)
    for _ in range(20):
        model = chat.Model(rng.integers(0, 9, 6), rng.integers(0, 9, (6, 6)), rng.integers(0, 9, (6, chat.FEATURES)))
        sequences = [rng.integers(0, chat.FEATURES, n) for n in (1, 4, 2, 5, 3)]
        before, after = rng.integers(-1, 6, 5), rng.integers(-1, 6, 5)
        for k, (f, states) in enumerate(zip(sequences, model.decode(sequences, before, after), strict=True)):
            def score(path, f=f, k=k):
                first = model.start[path[0]] if before[k] < 0 else model.step[before[k], path[0]]
                return first + sum(model.step[a, b] for a, b in itertools.pairwise(path)) + sum(model.emit[s, x] for s, x in zip(path, f, strict=True))

            paths = [p for p in itertools.product(range(6), repeat=len(f)) if after[k] < 0 or p[-1] == after[k]]
            assert abs(score(states) - max(map(score, paths))) < 1e-6 * (1 + abs(score(states)))


def test_chat_query_counts_all_lines(spark):
    """The query against a plain Viterbi over each conversation."""
    found = {r["conv_id"]: r for r in QUERIES["op9_chat"](spark, DATA).collect()}
    lines = chat.parse(chat.transcript_lines(spark.read.parquet(f"{DATA}/conversations.parquet")))
    model = chat.fit(lines)
    told = {}
    for r in lines.collect():
        told.setdefault(r["conv_id"], []).append((r["n"], r["feature"], r["role"], r["body"]))
    assert set(found) == set(told)
    for conv, rows in told.items():
        rows.sort()
        score, back = model.start + model.emit[:, rows[0][1]], []
        for _, f, _, _ in rows[1:]:
            through = score[:, None] + model.step
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + model.emit[:, f]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.insert(0, int(b[path[0]]))
        r, states = found[conv], [chat.STATES[s] for s in path]
        turns, texts = sum(first for _, first in states), []
        for (role, first), row in zip(states, rows, strict=True):
            if first:
                texts.append(f"<|{role}|>\n{row[3]}")
            else:
                texts[-1] += "\n" + row[3]
        texts = [t + "<|end|>\n" for t in texts]
        assert (r["n_lines"], r["n_right"], r["n_turns"]) == (len(rows), sum(s[0] == row[2] for s, row in zip(states, rows, strict=True)), turns)
        assert (r["n_chars"], r["rendered_sum"]) == (sum(map(len, texts)), sum(zlib.crc32(t.encode()) for t in texts))


def _brute(rows, queries, k):
    out = {}
    valid = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in valid:
        if q in queries:
            near = sorted((-float(x @ v / np.sqrt((x @ x) * (v @ v))), i) for i, v in valid if i != q)[:k]
            out[q] = near
    return out


def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(600)]
    rows += [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] + [1.0] * 7), (704, [float("inf")] * 8), (705, [1.0] * 5), (706, [])]
    rows += [(800 + k, rows[10][1]) for k in range(30)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, frame.where("vec_id % 50 = 0"), k=5, block_rows=64).collect()
    wanted = _brute(rows, {k for k, _ in rows if k % 50 == 0}, 5)
    assert {r["query_id"] for r in found} == set(wanted)
    hits = 0
    for q, near in wanted.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        hits += len({r[1] for r in own} & {i for _, i in near})
    assert hits >= 0.9 * 5 * len(wanted)
    ties = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 800)
    assert [v for _, v in ties] == [10, 801, 802, 803, 804]


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(12)]
    again = rows + [rows[k] for k in range(8) for _ in range(5)] + [(k, (2 * np.array(v)).tolist()) for k, v in rows[:6]]  # one leaf
    frame = spark.createDataFrame(again, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, queries, k=5, block_rows=64).collect()
    wanted = _brute(rows, {k for k, _ in rows}, 5)
    for q, near in wanted.items():
        assert [v for _, v in sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)] == [i for _, i in near]


def test_nearest_scans_less_than_half_and_finds_nine_tenths(spark):
    """The query on a whole table, against brute force; and the share of rows that a walk looks at."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in QUERIES["op10_nearest"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids.tolist() if i % 50 == 0}
    norm, hits = np.sqrt((x * x).sum(axis=1)), 0
    for at in np.flatnonzero(ids % 50 == 0).tolist():
        score = x @ x[at] / (norm * norm[at])
        score[ids == ids[at]] = -np.inf
        own = sorted(found[ids[at]])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and sorted(own, key=lambda r: (-r[2], r[1])) == own
        assert all(abs(score[ids == v].max() - s) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found)
    unit = x / norm[:, None]
    tree = vectors.Tree(unit)
    leaf = tree.leaf_of(unit)
    score = unit[::20] @ unit.T
    score[ids[::20][:, None] == ids[None, :]] = -np.inf
    most = vectors.calibrate(tree, unit[::20], [leaf[near].tolist() for near in np.argsort(-score, axis=1)[:, :5]])
    size = np.bincount(leaf, minlength=tree.leaves)
    assert np.mean([size[tree.visit(q, most)].sum() for q in unit[::20]]) < 0.4 * len(unit)


def test_nearest_walks_on_until_it_has_enough(spark):
    """Tight groups of few rows: the calibrated leaves alone would not hold five others."""
    rng = np.random.default_rng(6)
    rows = [(4 * c + n, (rng.normal(size=8) * 1e-6 + centre).tolist()) for c, centre in enumerate(rng.normal(size=(400, 8)) * 10) for n in range(4)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, block int")
    found = vectors.nearest(frame, frame.where("vec_id % 50 = 0"), k=9, recall=0.05, block_rows=50)
    assert {r["n"] for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {9}


def test_nearest_of_one_id_with_several_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.8, 0.2]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (0, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, frame.where("vec_id = 2")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 1, 0]


def test_nearest_with_few_and_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"]) for r in found] == [(1, 1), (2, 2)]
    assert vectors.nearest(frame.limit(0), frame).collect() == []


def test_pipeline_keeps_columns_and_takes_effect(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    texts = {r["doc_id"]: r["text"] for r in now.collect() if r["doc_id"] is not None}
    assert 1 in texts and not {2, 3, 4, 5, 6, 7, 17} & set(texts)  # copies, near copies and failures of the rules
    assert len(texts[11]) < len({r["doc_id"]: r["text"] for r in docs.collect()}[11])  # the shared passage is gone
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces if p["doc_id"] is not None} == set(texts)


def test_pipeline_stages_on_empty_and_clashing_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns, name


def test_pipeline_stages_neither_lose_nor_multiply_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string"
    one, two, three = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    rows = [(1, one), (1, two), (2, three), (2, three), (3, one), (None, two), (None, " ".join(f"d{k}" for k in range(60))), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k") for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted((r["doc_id"] or 99, r["text"] or "") for r in stages["near_dedup"](spark, docs, "").collect())
    assert kept == sorted([(1, one), (1, two), (2, three), (99, rows[6][1]), (4, ""), (4, "")])
    for name in ("suffix_dedup", "secret_scan"):
        assert stages[name](spark, docs, "").count() == len(rows), name
    cut = Counter(r["doc_id"] for r in stages["suffix_dedup"](spark, docs, "").where("length(text) < 10").collect())
    assert cut == {4: 2, 2: 1, 3: 1, None: 1}  # later copies lose all, first ones stay whole
    assert stages["quality_rules"](spark, docs, "").count() == 7
    assert stages["packing"](spark, docs, "").count() == len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, DATA)
    told = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = [tuple(r[columns.index(c)] for c in frame.columns) for r in told.fetchall()]
    assert Counter(rows) == Counter(map(tuple, frame.collect())) and rows


def test_urls_of_the_query_depend_on_the_list(spark):
    """On one host some pages are listed and some are not."""
    told = [r for r in QUERIES["op7_urls"](spark, "/root/testdata/sf0.1").collect() if r["rule"] is None and any(label in r["host"] for label in LISTED_LABELS)]
    assert {r["verdict"] for r in told} == {"allow", "block"}


def test_registered_queries():
    assert {re.match(r"op(\d+)_", k)[1] for k in QUERIES if k != "pipeline"} == {str(k) for k in range(1, 11)}
    assert set(ORACLE_SQL) <= set(QUERIES)
