"""Driver contract: entry smoke run, and every registered query against its
DuckDB twin on the smallest test tables (the driver does the same at sf0.01)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL

TABLES = ["events", "orders", "lineitem", "part", "customer", "documents", "embeddings", "benchmark", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 12))
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["user_id", "item_id", "score", "recommended"]
    rows = df.collect()
    assert len(rows) > 0
    assert any(r.recommended for r in rows)


def test_every_query_has_sql_or_is_listed():
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sqls) <= set(qs)
    assert not [q for q in set(qs) - set(sqls) if not re.match(r"op\d+_|pipeline$", q)]


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = duck.sql(entry_mod.oracle_sql()[name])
    orows, ocols = res.fetchall(), res.columns
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _norm(rows, cols) == _norm(orows, ocols)


def test_hashed_query_runs(spark):
    df = entry_mod.queries()["fit_hashed_seed"](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) == 5
    assert all(b.mean_log_likelihood >= a.mean_log_likelihood - 1e-9 for a, b in zip(rows, rows[1:]))
