"""Every query with SQL against DuckDB, over whole tables."""

import os

import duckdb
import pytest

from changelens.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(tidy, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(set(columns)) == len(columns)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
