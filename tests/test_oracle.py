"""Every registered query against its DuckDB oracle on sf0.001 (the driver's check, smaller)."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, key_of, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_every_key_of_the_match_library_has_an_oracle():
    from crease.plans.catalog import QUERIES

    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_works_without_the_optional_operators(monkeypatch):
    from crease.plans.catalog import QUERIES

    monkeypatch.setitem(sys.modules, "crease.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.delitem(sys.modules, "crease.llm.queries", raising=False)
    assert set(E.queries()) == set(QUERIES) == set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cols = df.columns
    got = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=key_of)
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=key_of)
    assert got == want
