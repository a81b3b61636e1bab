"""Registered queries of the engine against their DuckDB SQL, over whole tables of the smallest size."""

import duckdb
import pytest

from lodeseek.plans import table_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query(spark, duck, name):
    df = table_queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    want = duck.execute(table_queries.ORACLES[name])
    order = [[d[0] for d in want.description].index(c) for c in names]
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
