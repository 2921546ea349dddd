"""Registered queries of the library beside their SQL in DuckDB, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from dispersa.plans import library  # noqa: F401  registers its queries with the others
from dispersa.plans import queries as plans
from dispersa.streaming import queries as streams

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 3) + 0.0) if isinstance(v, float) else v


QUERIES = {**plans.QUERIES, **streams.QUERIES}
ORACLES = {**plans.ORACLE_SQL, **streams.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())

