"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from corpusflow import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    told = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = [tuple(plain(r[columns.index(c)]) for c in frame.columns) for r in told.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in frame.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
