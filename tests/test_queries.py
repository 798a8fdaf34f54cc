"""Every registered query against its SQL check, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_contract(spark):
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) > 130
    assert entry.entry(spark).columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in CHECKS:
        assert rows
        return
    result = con.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(clean(r[i]) for i in at) for r in result.fetchall()), key=key)
